"""The pipeline's stages, each on its own input, and the registered names."""

import re
from collections import Counter

import corpus_pipeline
from lodeworks.llm import langid, ngram_join, quality, queries
from tests.llm.test_text_ops import brute_seeds


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near_copies", "personal_data", "packing"]

    good = stages["quality"](spark, docs, sf_dir)
    want = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep")
    assert good.columns == columns and sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in want.collect())

    known = stages["language"](spark, good, sf_dir)
    want = langid.predict(good, langid.train(good.where(langid.in_training("doc_id")))).where("not rejected")
    assert known.columns == columns and sorted(r.doc_id for r in known.collect()) == sorted(r.doc_id for r in want.collect())

    single = stages["near_copies"](spark, known, sf_dir)
    want = {r.component_id for r in ngram_join.components(known).collect()}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == want and single.count() == len(want)

    masked = stages["personal_data"](spark, single, sf_dir)
    before, after = ({r.doc_id: r for r in df.collect()} for df in (single, masked))
    assert masked.columns == columns and before.keys() == after.keys()
    for i, r in before.items():
        assert not brute_seeds(after[i].text) and after[i].n_chars == len(after[i].text)
        if not brute_seeds(r.text):
            assert re.sub(r"\[(email|ip|card|phone)\]", "", after[i].text) == r.text or after[i].text == r.text

    packed = stages["packing"](spark, masked, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(after)
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= sum(fill.values()) / 1024 * 1.02 + 1


def test_run_and_names(spark, sf_dir):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_", n)[0] for n in names if re.match(r"op\d+_", n)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and set(queries.queries()) <= set(names)
    assert names["pipeline"](spark, sf_dir).count() > 0

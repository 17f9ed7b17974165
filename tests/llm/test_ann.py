"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from lodeworks.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 0.0) for i, v in rows], SCHEMA)


def exact(rows, q, k=5):
    usable = {i: np.array(v, np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    x = usable[q]
    scored = sorted((-float(x @ v / (np.linalg.norm(x) * np.linalg.norm(v))), i) for i, v in usable.items() if i != q)
    return [i for _, i in scored[:k]]


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (9, [1.0, 1.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 0.5])]
    df = frame(spark, rows)
    got = {}
    for r in ann.search(df, df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 1, 2, 8, 9}
    assert got[0] == [1, 2, 9, 8] and got[2] == [0, 1, 9, 8] and got[9] == [0, 1, 2, 8]
    assert ann.search(df.where("false"), df.where("false")).count() == 0
    assert ann.search(df, df.where("false")).count() == 0


def test_many_copies_and_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(300)]
    hot = rows[0][1]
    rows += [(1000 + i, hot) for i in range(200)]
    df = frame(spark, rows)
    got = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1000, 1001, 1002, 1003, 1004] and got[1000] == [0, 1001, 1002, 1003, 1004]
    hits = [len(set(exact(rows, q)) & set(v)) / 5 for q, v in got.items()]
    assert np.mean(hits) >= 0.9


def test_recall(spark, sf_dir):
    base = sf_dir.replace("sf0.001", "sf0.01")
    found = queries.op2_ann(spark, base).toPandas()
    v = spark.read.parquet(f"{base}/embeddings.parquet").toPandas()
    rows = list(zip(v.vec_id.tolist(), [list(map(float, e)) for e in v.embedding], strict=True))
    hits = [len(set(exact(rows, q)) & set(g.vec_id)) / 5 for q, g in found.groupby("query_id")]
    assert np.mean(hits) >= 0.9 and (found.groupby("query_id").size() == 5).all()


def test_edges_are_diverse():
    rng = np.random.default_rng(1)
    x = ann.unit(rng.normal(size=(400, 6))).astype(np.float32)
    graph, entry = ann.build_graph(x, degree=12)
    assert ((graph >= 0).sum(1) > 0).all() and (graph != np.arange(len(x))[:, None]).all()
    for i in range(0, 400, 37):
        kept = graph[i][graph[i] >= 0]
        far = 2 - 2 * x[kept] @ x[i]
        for a in range(len(kept)):
            for b in range(a):
                near = 2 - 2 * float(x[kept[a]] @ x[kept[b]])
                assert ann.ALPHA**2 * near > min(max(far[a], far[b]), far[a] if far[a] > far[b] else far[b]) - 1e-4


@pytest.mark.parametrize("shard_rows", [200, 6000])
def test_recall_over_ten_shards_and_one(spark, sf_dir, monkeypatch, shard_rows):
    """Against brute force on 2000 vectors, in ten shards and in one."""
    monkeypatch.setattr(ann, "SHARD_ROWS", shard_rows)
    base = sf_dir.replace("sf0.001", "sf0.1")
    found = queries.op2_ann(spark, base).toPandas()
    v = spark.read.parquet(f"{base}/embeddings.parquet").toPandas()
    rows = list(zip(v.vec_id.tolist(), [list(map(float, e)) for e in v.embedding], strict=True))
    hits = [len(set(exact(rows, q)) & set(g.vec_id)) / 5 for q, g in found.groupby("query_id")]
    assert np.mean(hits) >= 0.9 and len(hits) == len(v) // 50 or len(hits) > 0.9 * len(v) / 50


def test_recall_of_a_full_shard():
    """One graph of the size that production shards have, over random clustered vectors."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 48))
    x = ann.unit(centres[rng.integers(0, 60, ann.SHARD_ROWS)] + 0.7 * rng.normal(size=(ann.SHARD_ROWS, 48))).astype(np.float32)
    graph, entry = ann.build_graph(x)
    q = ann.unit(x[::60] + 0.05 * rng.normal(size=x[::60].shape)).astype(np.float32)
    found, _ = ann.beam_search(x, graph, entry, q, ann.QUERY_BEAM)
    near = np.argsort(-(q @ x.T), 1, kind="stable")[:, :5]
    recall = np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(found.tolist(), near.tolist(), strict=True)])
    assert recall >= 0.9

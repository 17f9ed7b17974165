"""Steps whose work must grow no faster than their input, and results that no limit may cut."""

import random
import re

from lodeworks.functions import names
import duckdb
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import crossref, graph, history, layout, ontology, producers, results
from lodeworks.plans import catalogue
from lodeworks.sources import texts


def rows_made(df) -> int:
    """The most rows that one step of the executed plan gave."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        found = node.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_repeated_rules_do_not_multiply_symbols(spark):
    symbols = spark.range(200).selectExpr("concat('s', id) as sym", "'x' as pretty")
    rules = spark.range(200).selectExpr("'x' as pretty", "'large' as label")
    found = ontology.labels_by_name(symbols, rules)
    assert rows_made(found) <= 400
    assert found.count() == 200


def test_renames_broadcast_no_lines(spark):
    files = spark.range(4).selectExpr("1L as rev", "concat('f', id) as path", "concat('a', id, '\nb', id) as text")
    found = history.renames(files, files.selectExpr("rev", "concat('new', path) as path", "text"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.old_path, r.similarity) for r in found.collect()} == {(f"newf{i}", f"f{i}", 100) for i in range(4)}


def test_names_of_one_prefix_and_no_broadcast_of_symbols(spark, monkeypatch):
    monkeypatch.setattr(producers, "FEW_NAMES", 0, raising=False)
    names = spark.range(1, 10).selectExpr("concat('Brand#', id) as name")
    symbols = spark.range(900).selectExpr("id as ord", "concat('Brand#', id % 9 + 1) as sym")
    found = producers.symbols_with_part(names.unionByName(spark.sql("select 'Brand#x' as name")), symbols, 6)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(f"Brand#{i}", f"Brand#{i}") for i in range(1, 10)}
    odd = spark.createDataFrame([("abcdef",), ("abcabcabc",), ("short",)], "name string")
    held = spark.createDataFrame([(1, "xabcdefx"), (2, "abcdeg"), (3, "abcabcabcabc"), (4, "abcabcab")], "ord int, sym string")
    assert {tuple(r) for r in producers.symbols_with_part(odd, held, 6).collect()} == {("abcdef", "xabcdefx"), ("abcabcabc", "abcabcabcabc")}


def test_expansion_without_limits_is_whole_and_in_the_order_of_the_queue(spark):
    wide = spark.range(150).selectExpr("'r' as sym", "'subclasses' as relation", "concat('c', id) as other")
    seed = spark.createDataFrame([("r",)], "sym string")
    assert graph.expand_relations(seed, wide)[0].count() == 1
    assert graph.expand_relations(seed, wide, None, None)[0].count() == 151
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(30)}", rng.choice(("overriddenBy", "overrides", "subclasses", "supers")), f"s{rng.randrange(30)}") for _ in range(70)]
    mixed, seeds = spark.createDataFrame(rows, "sym string, relation string, other string"), spark.createDataFrame([("s1",), ("s2",)], "sym string")
    queue = {tuple(r) for r in graph.expand_relations(seeds, mixed, 10**6, 10**6)[0].collect()}
    assert {tuple(r) for r in graph.expand_relations(seeds, mixed, None, None)[0].select("sym", "relation", "root", "distance").collect()} == queue


def test_facets_count_every_relation(spark):
    wide = spark.range(150).selectExpr("'r' as sym", "'subclasses' as relation", "concat('c', id) as other")
    rows, _ = graph.expand_relations(spark.createDataFrame([("r",)], "sym string"), wide, None, None)
    assert {tuple(r) for r in results.relation_facet(rows).collect()} == {("Self", 1), ("SubclassOf", 150)}


def test_facets_of_a_nation_of_many_suppliers_equal_the_sql(spark, tmp_path):
    spark.sql("select 1 as n_nationkey, 1 as n_regionkey union all select 2, 2").write.parquet(str(tmp_path / "nation.parquet"))
    spark.range(1300).selectExpr("id as s_suppkey", "cast(id % 3 as int) as s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for t in ("nation", "supplier"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = set(con.execute(catalogue.oracle_sql()["facet_relation"]).fetchall())
    assert want == {("Self", 1), ("SubclassOf", 434)}
    assert {tuple(r) for r in catalogue.queries()["facet_relation"](spark, str(tmp_path)).collect()} == want


def test_relations_listed_twice_or_without_names_count_as_in_the_sql(spark, tmp_path):
    nations = [(1, 1), (1, 1), (1, 2), (2, 1), (None, 1), (3, None)]
    suppliers = [(1, 1), (1, 1), (1, 2), (2, 2), (None, 1), (None, 1), (3, None), (4, 3)]
    spark.createDataFrame(nations, "n_nationkey int, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for t in ("nation", "supplier"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("facet_relation", "expand_relations"):
        want = con.execute(catalogue.oracle_sql()[name]).fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in catalogue.queries()[name](spark, str(tmp_path)).collect())
    assert ("SubclassOf", 14) in con.execute(catalogue.oracle_sql()["facet_relation"]).fetchall()


def test_every_way_is_counted_and_circles_have_no_end(spark):
    seed = spark.createDataFrame([("a",)], "sym string")
    links = [("a", "supers", "top"), ("top", "subclasses", "a"), ("top", "subclasses", "b"), ("a", "subclasses", "c"), ("a", "subclasses", "c"), ("a", "subclasses", "d"), ("d", "subclasses", "c")]
    rows, _ = graph.expand_relations(seed, spark.createDataFrame(links, "sym string, relation string, other string"), None, None, every_way=True)
    found = {(r.sym, r.relation, r.distance): r.ways for r in rows.collect()}
    assert found == {("a", "Queried", 0): 1, ("top", "SuperclassOf", 1): 1, ("c", "SubclassOf", 1): 2, ("d", "SubclassOf", 1): 1, ("c", "SubclassOf", 2): 1, ("a", "CousinClassOf", 2): 1, ("b", "CousinClassOf", 2): 1, ("c", "CousinClassOf", 3): 2, ("d", "CousinClassOf", 3): 1, ("c", "CousinClassOf", 4): 1}
    circle = spark.createDataFrame([("a", "subclasses", "b"), ("b", "subclasses", "a")], "sym string, relation string, other string")
    with pytest.raises(ValueError, match="circle"):
        graph.expand_relations(seed, circle, None, None, every_way=True)
    assert [graph.each_way(spark.range(1).withColumn("ways", F.lit(n).cast("long")), 3).count() for n in (1, 3, 4, 10)] == [1, 3, 4, 10]


def test_holes_run_through_rows_without_growing_arrays(spark):
    rng = random.Random(3)
    rows = []
    for c in range(20):
        for f in range(rng.randrange(1, 12)):
            bits = rng.random() < 0.5
            rows.append((f"c{c}", f"f{f}", rng.randrange(12), rng.randrange(1, 8), rng.randrange(8) if bits else None, rng.randrange(1, 20) if bits else None))
    want = set()
    for c in {r[0] for r in rows}:
        end = 0
        for _, f, o, s, b, w in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[4] or 0, r[5] is not None, r[5] or 0, r[3], r[1])):
            hole = max(o - end, 0)
            end = max(end, o + -(-(b + w) // 8)) if w is not None else o + s
            want.add((c, f, o, hole, end))
    found = layout.holes(spark.createDataFrame(rows, "cls string, field string, offset long, size long, bit_begin int, bit_width int"))
    assert {tuple(r) for r in found.collect()} == want
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()


def test_padding_is_the_largest_end_without_a_sort(spark):
    rng = random.Random(4)
    rows = [("back", "f", -9, 4, None, None), ("bits", "f", -9, 4, 0, 8), ("nulls", "f", 3, None, None, None), ("nulls", "g", None, 2, None, None), (None, "f", 2, 3, None, None)]
    for c in range(40):
        for f in range(rng.randrange(1, 6)):
            bits = rng.random() < 0.5
            rows.append((f"c{c}", f"f{f}", rng.randrange(-12, 12), rng.randrange(1, 8), rng.randrange(8) if bits else None, rng.randrange(1, 20) if bits else None))
    fields = spark.createDataFrame(rows, "cls string, field string, offset long, size long, bit_begin int, bit_width int")
    ends = {}
    for r in layout.holes(fields).collect():
        ends[r.cls] = max((e for e in (ends.get(r.cls), r.end) if e is not None), default=None)
    found = layout.end_padding(fields, fields.selectExpr("cls", "20L as size_bytes").distinct())
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(c, 0 if e is None else max(20 - e, 0)) for c, e in ends.items()}
    assert ends[None] == 5 and ends["back"] == -5 and ends["bits"] == 0


def test_blame_folds_many_files_of_a_partition_in_one_pass(spark):
    rows = [(f"f{i}", rev, text, parents) for i in range(50) for rev, text, parents in ((1, f"a{i}\nb{i}", []), (2, f"a{i}\nx{i}", [1]), (3, None, [2]))]
    found = history.blame(spark.createDataFrame(rows, "path string, rev long, text string, parents array<long>"))
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.path, r.rev, r.lno, r.orig_rev, r.orig_lno) for r in found.collect()}
    assert got == {(f"f{i}", *x) for i in range(50) for x in ((1, 1, 1, 1), (1, 2, 1, 2), (2, 1, 1, 1), (2, 2, 2, 2), (3, 1, 3, 1))}


def test_blame_of_renamed_files_folds_in_one_pass(spark):
    rows = [x for i in range(30) for x in ((f"old{i}", 1, "a\nb", None), (f"new{i}", 2, "a\nc", f"old{i}"))]
    found = history.blame(spark.createDataFrame(rows, "path string, rev long, text string, old_path string"))
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.lno, r.orig_rev, r.orig_path) for r in found.where("rev = 2").collect()} == {(f"new{i}", n, n, f"{o}{i}") for i in range(30) for n, o in ((1, "old"), (2, "new"))}


def test_families_do_not_multiply_links(spark, monkeypatch):
    written, kept = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda *a: written.append(kept(*a)) or written[-1])
    rng = random.Random(6)
    links = [(f"h{i:03}", "hub") for i in range(200)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("self", "self"), (None, "x"), ("y", None)]
    links += [(f"r{rng.randrange(60):02}", f"r{rng.randrange(60):02}") for _ in range(50)]
    root = {}
    for a, b in ((a, b) for a, b in links if a and b):
        while a in root:
            a = root[a]
        while b in root:
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
    want = set()
    for sym in root:
        first = sym
        while first in root:
            first = root[first]
        want.add((sym, first))
    found = graph.families(spark.createDataFrame(links, "a string, b string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert max(df.count() for df in written) <= len(links) and len(written) <= 8


def test_blame_of_files_that_go_on_from_one_in_the_same_revision(spark):
    rows = [("a", 1, "p\nq", None), ("b", 1, "r\ns", None), ("copy", 2, "p\nx", "a"), ("more", 2, "y\nq", "a"), ("a", 3, "r\nt", "b"), ("b", 3, "u\nq", "a")]
    got = {tuple(r) for r in history.blame(spark.createDataFrame(rows, "path string, rev long, text string, old_path string")).where("rev > 1").collect()}
    copies = {("copy", 2, 1, 1, 1, "a"), ("copy", 2, 2, 2, 2, "copy"), ("more", 2, 1, 2, 1, "more"), ("more", 2, 2, 1, 2, "a")}
    assert got == copies | {("a", 3, 1, 1, 1, "b"), ("a", 3, 2, 3, 2, "a"), ("b", 3, 1, 3, 1, "b"), ("b", 3, 2, 1, 2, "a")}
    merged = [("a", 1, "p\nq", None, []), ("a", 2, "p\nx", None, [1]), ("copy", 2, "y\nq", "a", [1]), ("copy", 3, "p\nq", None, [2, 1]), ("copy", 4, "p\nx", "a", [2])]
    found = history.blame(spark.createDataFrame(merged, "path string, rev long, text string, old_path string, parents array<long>"), spark.createDataFrame([(2,)], "rev long"))
    assert {tuple(r) for r in found.where("rev > 2").collect()} == {("copy", 3, 1, 1, 1, "a"), ("copy", 3, 2, 1, 2, "a"), ("copy", 4, 1, 1, 1, "a"), ("copy", 4, 2, 1, 2, "a")}


def test_pairs_of_aliases_are_not_dealt(spark, monkeypatch):
    records = [(1, 7), (1, 8), (1, 8), (2, 9), (3, 5), (4, None), (5, 7)]
    aliases = [(7, 70), (8, 70), (8, 80), (9, 70), (9, 70), (None, 90), (6, 60), (7, None)]
    given = spark.createDataFrame(records, "record_id long, sym long"), spark.createDataFrame(aliases, "alias long, target long")
    for few in (0, 10):
        monkeypatch.setattr(crossref, "FEW_ALIASES", few, raising=False)
        found = crossref.replace_aliases(*given)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("Join")[0]
        assert sorted(map(tuple, found.collect()), key=str) == sorted({(r, t) for r, s in records for a, t in aliases if s is not None and s == a}, key=str)


def test_fields_of_a_common_type_are_not_dealt(spark):
    kind = "case when id % 2 = 0 then 'int' when id % 4 = 1 then 'class ns::A *' else concat('Ref<class ns::P', id, '>') end"
    fields = spark.range(4000).selectExpr("'O' as owner", "concat('F', id) as field", f"{kind} as type")
    symbols = spark.range(4000).selectExpr("concat('ns::P', id) as pretty", "concat('T_', id) as sym").union(spark.sql("select 'ns::A', 'T_A'"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ontology.pointer_edges(fields, names.TypeRules(pointers={"Ref": ("strong", 0)}, values={"int"}), symbols)
        assert "BroadcastExchange" in found._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r) for r in found.select("field", "kind", "target").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(f"F{i}", "raw", "T_A") if i % 4 == 1 else (f"F{i}", "strong", f"T_{i}") for i in range(1, 4000, 2)}


def test_words_are_numbered_without_dealing_them(spark, monkeypatch):
    monkeypatch.setattr(texts, "PIECE", 40, raising=False)
    docs = [(i, t, "en", "s") for i, t in enumerate(["The cat, the CAT\n\n the\u00e9nd \U0001f600 a", "", None, "1 2 3", "x\ny\r\nx", "Z " * 60])] + [(0, "zebra the", "en", "s")]
    found = texts.tokens(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    want = sorted((d, n, m.start(), m[0].lower()) for d, t, _, _ in docs if t is not None for n, line in enumerate(t.split("\n"), 1) for m in re.finditer("[A-Za-z]+", line))
    rows = found.collect()
    assert sorted((r.doc_id, r.lno, r.col, r.token) for r in rows) == want
    firsts = sorted((r.doc_id, r.token, r.lno, r.col) for r in rows if r["first"])
    assert firsts == sorted((d, w, *min((n, c) for e, n, c, x in want if (e, x) == (d, w))) for d, w in {(d, w) for d, _, _, w in want})

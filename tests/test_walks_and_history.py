"""Walks with their rules and limits, deep chains, folds over revisions, stored indexes."""

import gzip
import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lodeworks import storage
from lodeworks.functions import names, paths, templating
from lodeworks.operators import graph, history, layout, legacy, lookup, merge, producers
from lodeworks.plans import catalogue, runner
from lodeworks.sources import records

from .conftest import ROOT

LINK = "sym string, relation string, other string, kind string, path string, ord int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def links(spark, *given):
    return spark.createDataFrame([(a, r, b, "k", p[0] if p else None, i) for i, (a, r, b, *p) in enumerate(given)], LINK)


def test_chains_of_any_length_are_whole(spark):
    n = 80
    chain = spark.createDataFrame([(f"s{i:03d}", f"s{i + 1:03d}") for i in range(n)], "src string, dst string")
    found = {r.sym: r.distance for r in graph.closure(spark.createDataFrame([("s000",)], "sym string"), chain).collect()}
    assert found == {f"s{i:03d}": i for i in range(n + 1)}


def test_deep_and_cyclic_bases(spark):
    supers = [(f"c{i}", f"c{i + 1}", 1) for i in range(24)] + [("x", "y", 2), ("y", "x", 3)]
    got = {(r.cls, r.base): (r.offset, r.depth) for r in layout.with_bases(spark.createDataFrame(supers, "cls string, base string, offset long")).collect()}
    assert got["c0", "c24"] == (24, 24) and got["x", "y"] == (2, 1) and ("x", "x") not in got


def test_rewrites_end_at_a_fixpoint_or_a_cycle(spark):
    rules = [(f"p{i}/", f"p{i + 1}/") for i in range(24)] + [("a/", "b/"), ("b/", "a/")]
    urls = spark.createDataFrame([("p0/f",), ("a/g",), ("z",)], "url string")
    got = {r.url: r.path for r in history.map_to_fixpoint(urls, spark.createDataFrame(rules, "from_prefix string, to_prefix string")).collect()}
    assert got == {"p0/f": "p24/f", "a/g": "b/g", "z": "z"}


def test_expansion_goes_on_to_the_end(spark):
    rel = spark.createDataFrame([(f"c{i}", "subclasses", f"c{i + 1}") for i in range(20)], "sym string, relation string, other string")
    got, over = graph.expand_relations(spark.createDataFrame([("c0",)], "sym string"), rel)
    assert got.count() == 21 and not over


def test_walk_direction_labels_and_badges(spark):
    table = links(spark, ("A", "supers", "S"), ("S", "subclasses", "A"), ("S", "subclasses", "B"), ("S", "supers", "T"), ("A", "subclasses", "C"), ("C", "supers", "A"), ("C", "supers", "X"), ("C", "fields", "F"), ("F", "supers", "G"))
    met = graph.walk(["A"], table, "class")
    # What was met upwards goes on upwards only, what was met downwards downwards only; a field starts anew.
    assert list(met.edges.items()) == [(("A", "C"), "inheritance"), (("S", "A"), "inheritance"), (("C", "F"), "k"), (("T", "S"), "inheritance"), (("G", "F"), "inheritance")]
    labels = spark.createDataFrame([("S", graph.BADGE + "base"), ("C", graph.STOP["class"])], "sym string, label string")
    met = graph.walk(["A"], table, "class", labels)
    assert met.badges == [("A", "base")] and list(met.edges) == [("A", "C")]
    assert list(graph.walk(["C"], table, "class", labels).edges)[0] == ("C", "F")  # a seed is walked from


def test_walk_limits_and_order(spark):
    table = links(spark, ("f", "overrides", "g"), ("f", "uses", "a", "p1"), ("f", "uses", "b", "p2"), ("b", "uses", "f", "p1"), ("b", "overrides", "g"), ("a", "uses", "z", "p1"), ("r", "slot_recv", "s"), ("r", "uses", "t", "p"))
    met = graph.walk(["f"], table, "uses", max_depth=2)
    assert list(met.edges) == [("g", "f"), ("a", "f"), ("b", "f"), ("z", "a"), ("f", "b")]  # a repeated override gives no edge
    assert [o["kind"] for o in met.overloads] == ["DepthLimitOnUses"] and met.nodes["z"] == 2
    assert list(graph.walk(["r"], table, "uses").edges.items()) == [(("s", "r"), "ipc")]  # a message ends the list
    met = graph.walk(["f"], table, "uses", node_limit=3)
    assert [o["kind"] for o in met.overloads] == ["NodeLimit"] and len(met.nodes) == 4
    named = spark.createDataFrame([("a", "Ignored"), ("b", "B")], "sym string, pretty string")
    met = graph.walk(["f"], table, "uses", names=named, ignore=frozenset(["Ignored"]))
    assert ("a", "f") not in met.edges and "a" in met.nodes
    many = links(spark, *[("m", "uses", f"c{i}", f"p{i}") for i in range(4)], *[("n", "uses", f"d{i}", "p0") for i in range(3)], ("n", "uses", "e", "p1"))
    met = graph.walk(["m", "n"], many, "uses", skip_uses_at=4)
    assert [(o["kind"], o["sym"]) for o in met.overloads] == [("UsesPaths", "m"), ("UsesLines", "n")] and sorted(met.edges) == [("d0", "n"), ("d1", "n"), ("d2", "n")]


def test_edges_between_ends():
    edges = [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("c", "x"), ("d", "a"), ("d", "e")]
    assert graph.edges_between(edges, {"a"}, {"d"}, 8) == [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d")]
    assert graph.edges_between(edges, {"a"}, {"e"}, 3) == [] and len(graph.edges_between(edges, {"a"}, {"e"}, 4)) == 5
    assert graph.edges_between(edges, {"a"}, {"d"}, 8, node_limit=3) == [("a", "b"), ("b", "d")]
    clique = [(f"n{i}", f"n{j}") for i in range(9) for j in range(9) if i != j]
    assert len(graph.edges_between(clique, {"n0"}, {"n1"}, 3)) == 15


def test_rendered_queries(spark):
    table = links(spark, ("sym1", "callees", "sym2"), ("sym2", "callees", "sym3"))
    named = spark.createDataFrame([(f"sym{i}", f"ns::name{i}") for i in (1, 2, 3)], "sym string, pretty string")
    ids = named.select(F.col("pretty").alias("id"), "sym", F.upper("pretty").alias("id_upper"))
    none = spark.createDataFrame([], "path string, path_kind string, lno int, text string, sym string, kind string")
    index = runner.Index(none, none, ids, none, named, links=table)
    assert rows(runner.run(index, "calls-from:ns::name1")) == [("sym1", "sym2", "default"), ("sym2", "sym3", "default")]
    assert rows(runner.run(index, "calls-from:ns::name1 depth:1")) == [("sym1", "sym2", "default")]
    dot = runner.run(index, "calls-from:ns::name1 graph-format:dot colorize-callees:name3").first().text
    assert dot.startswith("digraph") and dot.count("->") == 2 and "filled" in dot
    told = json.loads(runner.run(index, "calls-from:ns::name1 graph-format:json hier:pretty").first().text)
    assert told["graph"]["nodes"] == ["sym1", "sym2", "sym3"] and told["tree"]["children"][0]["name"] == "ns"
    with pytest.raises(runner.QueryError):
        runner.run(index, "calls-from:ns::name1 graph-format:svg")
    assert runner.run_legacy(index, "ab").count() == 0


def test_kept_lines_equal_plain_matching():
    old, new = list("aabcdzz"), list("aaxcdyzz")
    assert history.kept_lines(old, new) == [(1, 1), (2, 2), (4, 4), (5, 5), (7, 6), (8, 7)]
    assert history.kept_lines([], ["a"]) == [] and history.kept_lines(["a"], ["a"]) == [(1, 1)] and history.kept_lines(["a", "a"], ["a"]) == [(1, 1)]


def test_first_parent_wins_and_ignored_revisions_pass_on(spark):
    made = [("p", 1, "a\nb", []), ("p", 2, "a\nc", [1]), ("p", 3, "a\nc", [1]), ("p", 4, "a\nc", [2, 3]), ("p", 5, "A\nc\nnew", [4])]
    v = spark.createDataFrame(made, "path string, rev long, text string, parents array<long>")
    got = {(r.rev, r.lno): (r.orig_rev, r.orig_lno) for r in history.blame(v).collect()}
    assert got[4, 2] == (2, 2) and got[5, 1] == (5, 1) and got[5, 2] == (2, 2) and got[5, 3] == (5, 3)
    skipped = {(r.rev, r.lno): (r.orig_rev, r.orig_lno) for r in history.blame(v, spark.createDataFrame([(5,)], "rev long")).collect()}
    assert skipped[5, 1] == (1, 1) and skipped[5, 3] == (5, 3)


def test_packed_and_headed_files(spark, tmp_path):
    plain, packed = tmp_path / "a.json", tmp_path / "b.json.gz"
    plain.write_text('{"h": 1}\n{"x": 1}\n{"x": 2}\n')
    with gzip.open(packed, "wt") as f:
        f.write('{"h": 2}\n{"x": 3}\n')
    assert records.existing_path(spark, str(plain)) == str(plain) and records.existing_path(spark, str(tmp_path / "b.json")) == str(packed)
    for path, head, body in ((plain, 1, [1, 2]), (packed, 2, [3])):
        heads, found = records.read_headed(spark, str(path), "h int", "x int")
        assert [r.h for r in heads.collect()] == [head] and sorted(r.x for r in found.collect()) == body
    (tmp_path / "c.toml").write_text('[kinds]\nnormal = ["a"]\n')
    assert records.read_config(spark, str(tmp_path / "c.toml")) == {"kinds": {"normal": ["a"]}}


def test_stored_identifiers_prune_by_prefix(spark, tmp_path):
    """A prefix search filters on the sorted key, so that the scan can leave out row groups."""
    ids = spark.range(20_000).select(F.format_string("Name%05d", "id").alias("id"), F.col("id").cast("string").alias("sym"))
    records.write_identifiers(ids, str(tmp_path / "ids"), parts=4)
    found = spark.read.parquet(str(tmp_path / "ids")).where(F.col("id_upper").between("NAME019", "NAME019~"))
    assert found.count() == 100
    assert "PushedFilters: [IsNotNull(id_upper), GreaterThanOrEqual(id_upper,NAME019)" in found._jdf.queryExecution().executedPlan().toString()
    import pyarrow.parquet as pq

    files = [pq.ParquetFile(p).metadata.row_group(0) for p in (tmp_path / "ids").glob("*.parquet")]
    column = [i for i in range(3) if files[0].column(i).path_in_schema == "id_upper"][0]
    spans = [(g.column(column).statistics.min, g.column(column).statistics.max) for g in files]
    assert len(spans) > 1 and sum(a <= "NAME019~" and b >= "NAME019" for a, b in spans) < len(spans)


def test_a_stored_index_is_pruned_by_symbols(spark, tmp_path):
    hits = spark.range(4000).select(F.format_string("s%04d", "id").alias("sym"), F.lit("def").alias("kind"), F.lit("a/b").alias("path"), F.lit("normal").alias("path_kind"), F.col("id").cast("int").alias("lno"))
    named = hits.select("sym", F.concat(F.lit("name"), "sym").alias("pretty"))
    ids = named.select(F.col("pretty").alias("id"), "sym", F.upper("pretty").alias("id_upper"))
    kinds = spark.createDataFrame([("a/b", "normal")], "path string, path_kind string")
    lines = spark.createDataFrame([("a/b", 1, "x")], "path string, lno int, text string")
    index = runner.Index(kinds, lines, ids, hits, named)
    runner.store(index, str(tmp_path / "index"))
    found = runner.run(runner.load(spark, str(tmp_path / "index")), "id:names0123")
    assert [(r.kind, r.pretty, r.l0) for r in found.collect()] == [("Definitions", "names0123", 123)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(sym,s0123)" in plan or "In(sym, [s0123])" in plan
    assert runner.load(spark, str(tmp_path / "index")).relations is None


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert storage.shared_dir(Session()) == storage.LOCAL_DIR


def test_small_scalars(spark):
    one = spark.range(1)
    assert one.select(paths.unmangle(F.lit("a@2Eb@40@")).alias("x")).first().x == "a.b@@"
    order = [r.p for r in spark.createDataFrame([("f10",), ("F9",), ("f0100",), ("f" + "1" * 40,), ("f2b",)], "p string").orderBy(paths.natural_key(F.col("p"))).collect()]
    assert order == ["f2b", "F9", "f10", "f0100", "f" + "1" * 40]
    with pytest.raises(ValueError):
        templating.render("{{ a | nothing }}", {})
    rules = names.TypeRules(pointers={"Ptr": ("strong", 0)}, containers={"List"}, values={"int"})
    assert names.pointees("List<Ptr<class ns::A>>", rules)[0] == [("strong", "ns::A")] and names.pointees("Unknown<class ns::A>", rules)[0] == []


def test_merging_two_kinds_of_expansions_is_an_error(spark):
    made = spark.createDataFrame([("l", 0, "a", {"m": "1"}), ("l", 1, "b", {"m": "2"})], "loc string, platform_ord int, expansion_kind string, expansion map<string,string>")
    with pytest.raises(Exception, match="two kinds"):
        merge.merge_expansions(made, ["loc"]).collect()


def test_needles_and_manifests(spark):
    assert legacy.needle_pieces(r"a\.b.c::d") == ["a", "b", "c", "d"] or legacy.needle_pieces(r"a\.b.c::d")[-1] == "d"
    text = 'head = ["h.js", "../i.js"]\n\n["test_a.js"]\nsupport-files = "s.js"\n["include:common.toml"]\n'
    got = rows(producers.manifest_files(spark.createDataFrame([("d/m.toml", text), ("bad.toml", "=")], "path string, text string")).select("lno", "kind", "pretty"))
    assert got == sorted([(1, "def", "d/m.toml"), (1, "use", "d/h.js"), (1, "use", "i.js"), (3, "use", "d/test_a.js"), (4, "use", "d/s.js"), (5, "use", "d/common.toml")], key=repr)


def test_every_query_is_registered_once():
    found = catalogue.queries()
    assert len(found) > 140 and set(catalogue.oracle_sql()) <= set(found)


def test_ranges_open_and_close_as_lines_go(spark):
    made = [("f", 1, 0, "A", 1, 20), ("f", 1, 9, "A2", 1, 20), ("f", 3, 0, "B", 3, 8), ("f", 4, 0, "short", 4, 5), ("f", 8, 0, "C", 8, 19), ("f", 30, 0, "lone", 30, 30), ("f", 31, 0, "none", 0, 0)]
    got = rows(lookup.sticky_ranges(spark.createDataFrame(made, "path string, lno int, col int, sym string, first int, last int")))
    assert got == sorted([("f", 1, "A", 0), ("f", 3, "B", 0), ("f", 7, None, 1), ("f", 8, "C", 0), ("f", 18, None, 1), ("f", 19, None, 1), ("f", 30, "lone", 1)], key=repr)


@pytest.mark.parametrize("hidden", ["", "xxhash", "lodeworks.llm"])
def test_queries_are_listed_without_a_session_or_a_module(hidden):
    """The driver lists queries before it has a session; without a module that only some need, the rest is there."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Hide:
    def find_spec(self, name, path=None, target=None):
        if {hidden!r} and name == {hidden!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
assert len(e.queries()) >= 146 and set(e.oracle_sql()) <= set(e.queries())
assert not ({hidden!r} and "pipeline" in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)

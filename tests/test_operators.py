"""Operators on small hand-made tables."""

import json

from pyspark.sql import functions as F

from lodeworks.operators import coverage, crossref, filters, graph, history, layout, loganalytics, lookup, merge, ontology, results
from lodeworks.sources import coverage_report, logs, records


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_records(spark, tmp_path):
    lines = [
        {"loc": "1:4-5", "source": 1, "syntax": "def,prop", "pretty": "property x", "sym": "#x"},
        {"loc": "1:4", "target": 1, "kind": "def", "pretty": "x", "sym": "#x"},
        {"loc": "2:5", "target": 1, "kind": "use", "pretty": "x", "sym": "#x,#y"},
        {"structured": 1, "sym": "#x", "pretty": "x", "kind": "field", "unknown": 7},
    ]
    (tmp_path / "a").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n{}\n")
    got = records.read_records(spark, str(tmp_path)).cache()
    assert got.groupBy("record_type").count().count() == 3 and got.count() == 4
    assert rows(filters.filter_records(got, kind="def").select("loc")) == [("1:4",), ("1:4-5",)]
    assert filters.filter_records(got, symbol="#y").count() == 1
    assert filters.filter_records(got, identifier="x", record_types=["source"]).count() == 1
    assert filters.filter_records(got, symbol_prefix="#z").count() == 0
    assert [r.place.lineno for r in records.by_location(got.where("place is not null")).collect()] == [1, 1, 2]


def test_merge(spark):
    made = spark.createDataFrame([("l", "x", 0, "def", "a,b", "t1", 0), ("l", "x", 1, "use", "c,a", "t2", 1)], "loc string, pretty string, no_crossref int, syntax string, sym string, type string, p int")
    df = made.withColumn("platform", F.col("p").cast("string")).withColumn("platform_ord", F.col("p")).withColumn("ord", F.col("p"))
    df = df.withColumn("nesting", F.struct(F.lit(1).alias("l1"), F.lit(0).alias("c1"), (F.col("p") + 3).alias("l2"), F.lit(1).alias("c2")))
    r = merge.merge_sources(df, ["loc", "pretty"]).first()
    assert (r.no_crossref, r.syntax, r.sym, r.type, r.nesting.l2) == (False, "def,use", "c,a,b", "t1", 4)


def test_callees_first_path_only(spark):
    t = spark.createDataFrame([("a", 1, "use", "f", "F", "m", 0), ("a", 2, "use", "f", "F", "m", 1), ("b", 9, "use", "f", "F", "m", 2), ("b", 1, "use", "g", "G", "m", 3)], "path string, lno int, kind string, sym string, pretty string, contextsym string, ord int")
    meta = spark.createDataFrame([("f", "function")], "sym string, kind string")
    got = crossref.callees(t, meta, crossref.names(t))
    assert rows(got.select("caller", "callee", "path", "lines")) == [("m", "f", "a", "1,2")]


def test_identifiers_and_search(spark):
    t = spark.createDataFrame([("ns::Thing::run", "s1"), ("ns::thing", "s2"), ("ns::Thing.x", "s3"), ("a/b.h", "FILE_ab"), ("num", "1x"), ("sp", "a b")], "pretty string, sym string")
    ids = crossref.identifiers(t).withColumn("id_upper", F.upper("id"))
    assert ("b.h", "FILE_ab") in rows(ids.select("id", "sym")) and ("a/b.h", "FILE_ab") in rows(ids.select("id", "sym"))
    assert not [r for r in rows(ids.select("id", "sym")) if r[1] in ("1x", "a b")]
    assert rows(lookup.search_identifiers(ids, ["thing"]).select("id", "sym", "rank")) == [("thing", "s2", 0)]
    assert rows(lookup.search_identifiers(ids, ["ns::th"]).select("id", "rank")) == [("ns::thing", 5)]
    assert lookup.search_identifiers(ids, ["ru"]).count() == 0
    assert rows(lookup.search_identifiers(ids, ["run"], exact=True).select("sym")) == [("s1",)]


def test_first_and_last_wins(spark):
    t = spark.createDataFrame([("s", "old", 1), ("s", "new", 2)], "sym string, pretty string, ord int").repartition(2)
    assert rows(crossref.names(t)) == [("s", "new")] and rows(crossref.first_record(t, "pretty")) == [("s", "old")]


def test_fourth_idl_symbol_empties_the_list(spark):
    t = spark.createDataFrame([("a", str(i)) for i in range(4)] + [("b", "x")], "sym string, idl string")
    assert [r.sym for r in crossref.idl_symbols(t).collect()] == ["b"]


def edges(spark, text):
    return spark.createDataFrame([(*e.split(">"), "default", i) for i, e in enumerate(text.split())], "src string, dst string, kind string, ord int")


def test_traverse(spark):
    e = edges(spark, "a>b b>c c>a b>d d>e")
    seeds = spark.createDataFrame([("a",)], "sym string")
    nodes, walked = graph.traverse(seeds, e, 2)
    assert rows(nodes) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]
    assert rows(walked.select("src", "dst")) == [("a", "b"), ("b", "c"), ("b", "d")]
    stop = spark.createDataFrame([("b",)], "sym string")
    assert rows(graph.traverse(seeds, e, 5, stop)[0]) == [("a", 0), ("b", 1)]
    nodes, out, over = graph.traverse_limited(["a"], e, 8, node_limit=3)
    assert over[0]["kind"] == "NodeLimit" and len(nodes) >= 3
    nodes, out, over = graph.traverse_limited(["a"], e, 2)
    assert [o["kind"] for o in over] == ["DepthLimit", "DepthLimit"] and ("b", "c", "default") in out


def test_paths_and_closure(spark):
    e = edges(spark, "a>b b>c a>c c>d b>d d>a")
    ends = [spark.createDataFrame([(x,)], "sym string") for x in "ad"]
    assert [r.path for r in graph.paths_between(*ends, e, 4).orderBy("path").collect()] == ["a>b>c>d", "a>b>d", "a>c>d"]
    assert graph.paths_between(*ends, e, 3).count() == 2
    assert graph.closure(ends[0], e).count() == 4


def test_expand_limits(spark):
    rel = spark.createDataFrame([("c", "subclasses", f"s{i}") for i in range(3)] + [("c", "supers", "p"), ("p", "subclasses", "c"), ("p", "subclasses", "k")], "sym string, relation string, other string")
    seeds = spark.createDataFrame([("c",)], "sym string")
    got, over = graph.expand_relations(seeds, rel)
    assert {(r.sym, r.relation) for r in got.collect()} == {("c", "Queried"), ("s0", "SubclassOf"), ("s1", "SubclassOf"), ("s2", "SubclassOf"), ("p", "SuperclassOf"), ("k", "CousinClassOf")} and not over
    got, over = graph.expand_relations(seeds, rel, local_limit=2)
    assert over[0]["exist"] == 3 and "s0" not in [r.sym for r in got.collect()]


def test_graph_output():
    e = [("a", "b", "default"), ("b", "c", "inheritance")]
    assert graph.to_json(e)["nodes"] == ["a", "b", "c"] and "n0 -> n1" in graph.to_dot(e, {}, ("c",))
    tree = graph.hierarchy([("s1", ["ns", "A", "f"]), ("s2", ["ns", "A", "g"])])
    assert tree["children"][0]["name"] == "ns::A" and len(tree["children"][0]["children"]) == 2


def test_common_ancestor(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    cases = [((("a", "b"), ("a", "c")), 1), ((("a",), ("a", "c")), 0), ((("x",), ("y",)), 0)]
    for (a, b), n in cases:
        assert spark.range(1).select(graph.common_ancestor(arr(*a), arr(*b)).alias("n")).first().n == n


def test_context_does_not_overlap(spark):
    spans = spark.createDataFrame([("p", 3, 3), ("p", 6, 6)], "path string, l0 int, l1 int")
    lines = spark.createDataFrame([("p", i, f"t{i}") for i in range(1, 9)], "path string, lno int, text string")
    got = rows(results.with_context(spans, lines, 4, 4).select("l0", "lno"))
    assert got == [(3, 1), (3, 2), (3, 3), (3, 4), (3, 5), (6, 4), (6, 5), (6, 6), (6, 7), (6, 8)]


def test_text_suppression_and_facets(spark):
    sem = spark.createDataFrame([("normal", "Uses", 0, "f", "a", 3, 3, 3)], "path_kind string, kind string, rank int, pretty string, path string, l0 int, l1 int, lno int")
    text = spark.createDataFrame([("normal", "a", 3), ("normal", "a", 4)], "path_kind string, path string, lno int")
    assert rows(results.compile_results(sem, text).select("kind", "l0")) == [("TextualOccurrences", 4), ("Uses", 3)]
    counts = {"a": 5, "a/b": 5, "a/b/x": 3, "a/b/y": 1, "a/b/z": 1}
    facet = results.path_facet(counts)
    assert facet[0]["label"] == "a/b" and [c["label"] for c in facet[0]["children"]] == ["x", "*"]
    assert results.path_facet({"a": 1, "a/b": 1}) == []


def test_coverage(spark):
    cases = {"empty": [], "hit": [1, None, None, 2], "miss": [0, None, 0], "mixed": [0, None, 3], "ends": [None, 1, None]}
    df = spark.createDataFrame([(k, i, v) for k, vs in cases.items() for i, v in enumerate(vs)], "k string, i int, hits bigint")
    got = {}
    for r in coverage.interpolate(df, ["k"], ["i"]).orderBy("k", "i").collect():
        got.setdefault(r.k, []).append(r.filled)
    assert got == {"hit": [1, 1, 1, 2], "miss": [0, 0, 0], "mixed": [0, 1, 3], "ends": [None, 1, None]}
    nodes = list(coverage_report.walk({"coveragePercent": 1.0, "children": {"d": {"children": {"f": {"coverage": [-1, 2]}}}}}))
    assert nodes[-1][0] == "d/f" and nodes[-1][-1] == [None, 2]


def test_layout(spark):
    f = spark.createDataFrame([("C", "a", 0, 4, None, None), ("C", "b", 8, 4, None, None), ("C", "x", 12, 4, 0, 3), ("C", "y", 12, 4, 3, 9)], "cls string, field string, offset long, size long, bit_begin int, bit_width int")
    assert [(r.field, r.hole, r.end) for r in layout.holes(f).orderBy("offset", "field").collect()] == [("a", 0, 4), ("b", 4, 12), ("x", 0, 13), ("y", 0, 14)]
    classes = spark.createDataFrame([("C", 16)], "cls string, size_bytes long")
    assert layout.end_padding(f, classes).first().padding == 2
    supers = spark.createDataFrame([("A", "B", 0), ("B", "D", 8)], "cls string, base string, offset long")
    assert rows(layout.with_bases(supers)) == [("A", "B", 0, 1), ("A", "D", 8, 2), ("B", "D", 8, 1)]


def test_blame(spark):
    v = spark.createDataFrame([("p", 1, "a\nb"), ("p", 2, "a\nx\nb"), ("p", 3, "x\nb")], "path string, rev long, text string")
    got = {(r.rev, r.lno): (r.orig_rev, r.orig_lno) for r in history.blame(v).collect()}
    assert got == {(1, 1): (1, 1), (1, 2): (1, 2), (2, 1): (1, 1), (2, 2): (2, 2), (2, 3): (1, 2), (3, 1): (2, 2), (3, 2): (1, 2)}


def test_history(spark):
    m = spark.createDataFrame([("index\ngit abc1 hg ff oldrevs d1,d2",)], "message string")
    assert rows(history.revision_aliases(m)) == [("abc1", "d1"), ("abc1", "d2"), ("abc1", "ff")]
    lines = spark.createDataFrame([("abc # why",), ("",), ("# all",)], "value string")
    assert rows(history.ignored_revisions(lines)) == [("abc",)]
    c = spark.createDataFrame([("N", "e"), ("M", "e"), ("Z", "z")], "author_name string, author_email string")
    mm = spark.createDataFrame([("N", "e", "Both", "b"), (None, "e", "Mail", "m")], "old_name string, old_email string, name string, email string")
    assert rows(history.canonical_authors(c, mm).select("author_name", "name")) == [("M", "Mail"), ("N", "Both"), ("Z", "Z")]
    urls = spark.createDataFrame([("x://a/f",)], "url string")
    rules = spark.createDataFrame([("x://a/", "y://b/"), ("y://b/", "src/")], "from_prefix string, to_prefix string")
    assert history.map_to_fixpoint(urls, rules).first().path == "src/f"


def test_logs(spark):
    lines = spark.createDataFrame([('2024-01-01T00:00:00Z HIT 0.5 "GET /tree/search?q=x HTTP/1.1" 200 10 "-" "agent"',), ("noise",)], "value string")
    r = logs.access_log(lines).first()
    assert (r.tree, r.action, r.request_time) == ("tree", "search", 0.5)
    steps = spark.createDataFrame([("2024-01-01T00:00:00Z section begin t A",), ("2024-01-01T00:00:10Z step begin t s1",)], "value string")
    assert loganalytics.sections(logs.step_log(steps)).first().n_steps == 1


def test_ontology(spark):
    sub = spark.createDataFrame([("R", "A"), ("A", "B"), ("B", "A")], "src string, dst string")
    symbols = spark.createDataFrame([("A", "Out::A"), ("B", "Two::B"), ("O", "Out"), ("W", "Two"), ("R", "Root")], "sym string, pretty string")
    roots = spark.createDataFrame([("R", "lab")], "sym string, label string")
    assert rows(ontology.labels_of_containing_class(roots, sub, symbols)) == [("O", "lab"), ("W", "lab")]
    methods = spark.createDataFrame([("m", "C", "C::run"), ("k", "C", "C::C"), ("d", "C", "C::dead")], "sym string, cls string, pretty string")
    over = spark.createDataFrame([("base", "m")], "src string, dst string")
    hits = spark.createDataFrame([("k",)], "sym string")
    assert rows(ontology.runnables(spark.createDataFrame([("base",)], "sym string"), over, methods, hits)) == [("m", "k")]


def test_range_join(spark):
    lines = spark.createDataFrame([("p", i) for i in (1, 63, 64, 200)], "path string, lno int")
    ranges = spark.createDataFrame([("p", 1, 100), ("p", 60, 300), ("p", 64, 64)], "path string, first int, last int")
    got = {r.lno: r.depth for r in lookup.nesting_depth(lines, ranges).collect()}
    assert got == {1: 1, 63: 2, 64: 2, 200: 1}


def test_producers(spark):
    from lodeworks.operators import producers

    lines = spark.createDataFrame([("a.css", 1, "@property --x {"), ("a.css", 2, ".p { --x: 1; color: var(--y); }"), ("p.yaml", 1, "- name: some.pref"), ("d/list.build", 1, 'SOURCES = ["x.c", "/top.c", "none.c"]')], "path string, lno int, text string")
    assert rows(producers.css_properties(lines.where("path = 'a.css'")).select("lno", "col", "kind", "pretty")) == [(1, 10, "decl", "--x"), (2, 5, "def", "--x"), (2, 24, "use", "--y")]
    assert rows(producers.preferences(lines).select("sym", "col")) == [("PREF_some_pref", 8)]
    files = spark.createDataFrame([("d/x.c",), ("x.c",), ("top.c",)], "path string")
    assert rows(producers.file_uses(lines, files).select("name", "target")) == [("/top.c", "top.c"), ("x.c", "d/x.c")]
    docs = spark.createDataFrame([("s", "text binding_to(cpp, class, A::b) and binding_to(js, func, c) bound_as(js, func, d)")], "sym string, documentation string")
    assert rows(producers.doc_bindings(docs)) == [("s", "binding_to", "cpp", "class", "A::b"), ("s", "bound_as", "js", "func", "d")]
    names_ = spark.createDataFrame([("4Name3fooE",)], "name string")
    syms = spark.createDataFrame([("_ZN4Name3fooEv", 0), ("_ZN2ns4Name3fooEi", 1), ("_ZN1a", 2)], "sym string, ord int")
    assert rows(producers.symbols_with_part(names_, syms)) == [("4Name3fooE", "_ZN2ns4Name3fooEi")]
    y = spark.createDataFrame([("f.yaml", "a:\n  b: 1\n  c:\n    d: 2\ne: 3\n")], "path string, text string")
    assert rows(producers.yaml_keys(y).select("lno", "key", "last")) == [(1, "a", 4), (2, "a.b", 2), (3, "a.c", 4), (4, "a.c.d", 4), (5, "e", 6)]


def test_render(spark):
    from lodeworks.operators import render

    one = spark.createDataFrame([("<p>a</p><script>x<y</script><!-- n --><b>c</b>",)], "h string")
    assert one.select(render.strip_tags(F.col("h")).alias("t")).first().t == "a c"
    assert one.select(render.elements(F.col("h"), "b").alias("t")).first().t == ["c"]
    masked = spark.createDataFrame([("at 2024-01-02 03:04 line 7",)], "h string").select(render.mask_unstable(F.col("h")).alias("t")).first().t
    assert masked == "at DATE line N"
    paths_ = spark.createDataFrame([("d/a.cpp",), ("d/a.h",), ("d/b.h",)], "path string")
    assert rows(render.counterpart(paths_, {"cpp": ["h", "hpp"], "h": ["cpp"]})) == [("d/a.cpp", "d/a.h"), ("d/a.h", "d/a.cpp")]
    listed = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "group int, k string, v int")
    assert render.dictify(listed, "k", "v").first().json == '{"a":1,"b":2}'

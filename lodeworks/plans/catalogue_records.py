"""Named queries of record files, producers, tokens, revisions and templates over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import locations, names, paths, templating, texts, tokenize
from ..operators import coverage, history, loganalytics, lookup, merge, ontology, producers, render
from ..sources import coverage_report
from ..sources import records as source_records
from ..sources import texts as source_texts
from ..storage import shared_dir
from .catalogue import _LINES, _PATH, _long, _part_hits, _t, files, query

# ---------------------------------------------------------------- record files


def _written(spark, name: str, lines):
    """A text file of lines, written once in the shared folder, as indexers would leave it."""
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    lines.write.text(path, compression="gzip")
    return path


@query("SELECT 'S_' || l_suppkey AS sym, l_linenumber::BIGINT AS lno, 'P' || l_partkey AS pretty, CASE l_returnflag WHEN 'A' THEN 'def' ELSE 'use' END AS kind FROM lineitem WHERE l_returnflag <> 'N'")
def read_target_records(spark, sf_dir):
    """Records written as gzipped NDJSON and read back by their schema; a line in three is malformed and dropped."""
    kind = F.when(F.col("l_returnflag") == "A", "def").otherwise("use")
    loc = F.concat(F.lpad(F.col("l_linenumber").cast("string"), 5, "0"), F.lit(":3-9"))
    good = F.to_json(F.struct(loc.alias("loc"), F.lit(1).alias("target"), kind.alias("kind"), F.concat(F.lit("P"), "l_partkey").alias("pretty"), F.concat(F.lit("S_"), "l_suppkey").alias("sym")))
    path = _written(spark, "records", _t(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "N", '{"loc": "00001:0", "target"').otherwise(good).alias("value")))
    found = source_records.read_records(spark, path).where("record_type = 'target'")
    return found.select("sym", F.col("place.lineno").cast("bigint").alias("lno"), "pretty", "kind")


@query("SELECT n_regionkey % 2 AS part, n_nationkey, n_name FROM nation")
def read_headed_records(spark, sf_dir):
    """Files of a header and its rows, one file for each half of the regions."""
    nation = _t(spark, sf_dir, "nation")
    found = None
    for part in (0, 1):
        rows = nation.where(F.col("n_regionkey") % 2 == part).select(F.lit(1).alias("o"), F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))
        head = spark.createDataFrame([(0, f'{{"part": {part}}}')], "o int, value string")
        path = _written(spark, "headed", head.unionByName(rows).repartition(1).sortWithinPartitions("o").select("value"))
        heads, body = source_records.read_headed(spark, path, "part long", "n_nationkey long, n_name string")
        one = body.join(heads, "file").select("part", "n_nationkey", "n_name")
        found = one if found is None else found.unionByName(one)
    return found


@query("SELECT p_brand AS sym, count(*) AS n FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size < 20) GROUP BY p_brand")
def sorted_lookup(spark, sf_dir):
    """A table sorted by its key in the shared folder, asked for some keys."""
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/sorted-{uuid.uuid4().hex}"
    part = _t(spark, sf_dir, "part")
    source_records.write_sorted(part.select(F.col("p_brand").alias("sym"), "p_partkey"), path, "sym")
    asked = part.where("p_size < 20").select(F.col("p_brand").alias("sym")).distinct()
    return spark.read.parquet(path).join(asked, "sym", "left_semi").groupBy("sym").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS id, 'P_' || p_partkey AS sym FROM part WHERE starts_with(upper(p_brand), 'BRAND#1')")
def stored_identifiers(spark, sf_dir):
    """Identifiers in the order of prefix searches, written and searched by a range of the upper-case key."""
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/identifiers-{uuid.uuid4().hex}"
    source_records.write_identifiers(_t(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.concat(F.lit("P_"), "p_partkey").alias("sym")), path)
    return spark.read.parquet(path).where(F.col("id_upper").between("BRAND#1", "BRAND#1~")).select("id", "sym")


@query(f"SELECT path, CASE WHEN n % 3 = 0 THEN 'FILE_own' || n ELSE 'FILE_' || replace(path, '.', '@2E') END AS sym FROM (SELECT {_PATH} AS path, doc_id AS n FROM documents)")
def file_symbols(spark, sf_dir):
    defs = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("X"), F.concat(F.lit("FILE_own"), "doc_id"))).otherwise(F.array(F.lit("X")))
    rows = files(spark, sf_dir).select("path", source_records.file_symbol(paths.mangle(F.col("path")), defs).alias("syms"))
    return rows.select("path", F.get("syms", F.lit(0)).alias("sym"))


# ---------------------------------------------------------------- merging


@query("""SELECT l_orderkey, 'S' || l_suppkey AS sym, CASE WHEN bool_or(l_linestatus = 'F') THEN 'concrete' ELSE 'cppTemplateHeuristic' END AS confidence FROM lineitem GROUP BY ALL""")
def merge_confidence(spark, sf_dir):
    level = F.when(F.col("l_linestatus") == "F", "concrete").otherwise("cppTemplateHeuristic")
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.array(F.concat(F.lit("S"), "l_suppkey")).alias("syms"), F.array(level).alias("confidence"))
    return merge.merge_confidence(rows, ["l_orderkey"])


@query("""WITH r AS (SELECT l_partkey, 'm' || l_linenumber AS name, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS p, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
 o AS (SELECT l_partkey, name, arg_max(flag, p) AS flag FROM r GROUP BY ALL) SELECT l_partkey, string_agg(name || '=' || flag, ',' ORDER BY name) AS expansion FROM o GROUP BY l_partkey""")
def merge_expansions(spark, sf_dir):
    ordinal = F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END")
    rows = _t(spark, sf_dir, "lineitem").select("l_partkey", ordinal.alias("platform_ord"), F.lit("macro").alias("expansion_kind"), F.create_map(F.concat(F.lit("m"), "l_linenumber"), F.col("l_returnflag")).alias("expansion"))
    merged = merge.merge_expansions(rows, ["l_partkey"])
    return merged.select("l_partkey", F.array_join(F.transform(F.map_entries("expansion"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("expansion"))


@query("SELECT p_brand AS sym, string_agg(DISTINCT l, ',' ORDER BY l) AS labels FROM (SELECT p_brand, p_type AS l FROM part UNION ALL SELECT p_brand, 'size' || p_size FROM part WHERE p_size < 5) GROUP BY p_brand")
def merge_labels(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    rows = ontology.merge_labels(part.select(F.col("p_brand").alias("sym"), F.col("p_type").alias("label")), part.where("p_size < 5").select(F.col("p_brand").alias("sym"), F.concat(F.lit("size"), "p_size").alias("label")))
    return rows.select("sym", F.array_join("labels", ",").alias("labels"))


# ---------------------------------------------------------------- producers


@query("SELECT o_orderkey, 8::BIGINT AS col, 'PREF_a_b_' || o_custkey AS sym, 'a.b-' || o_custkey AS pretty FROM orders")
def preference_records(spark, sf_dir):
    lines = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.lit(1).alias("lno"), F.concat(F.lit("- name: a.b-"), "o_custkey", F.lit(" # x")).alias("text"))
    return producers.preferences(lines).select(F.col("path").alias("o_orderkey"), *_long("col"), "sym", "pretty")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'decl' WHEN 1 THEN 'def' ELSE 'use' END AS kind, 'CSS_--c' || p_size AS sym FROM part""")
def style_properties(spark, sf_dir):
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("@property --c"), "p_size", F.lit(" {"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("a { --c"), "p_size", F.lit(": 1 }"))).otherwise(F.concat(F.lit("a { b: var(--c"), "p_size", F.lit(") }")))
    lines = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.lit(1).alias("lno"), text.alias("text"))
    return producers.css_properties(lines).select(F.col("path").alias("p_partkey"), "kind", "sym")


@query("""WITH f AS (SELECT doc_id, source || '/f' || doc_id || '.c' AS path FROM documents), u AS (SELECT doc_id, source || '/build' AS path, doc_id % 2 = 0 AS near, source FROM documents)
 SELECT u.doc_id, CASE WHEN near THEN source || '/f' || u.doc_id || '.c' ELSE 'src0/f' || g.doc_id || '.c' END AS target FROM u LEFT JOIN (SELECT min(doc_id) AS doc_id FROM documents WHERE source = 'src0') g ON true WHERE near OR g.doc_id IS NOT NULL""")
def build_file_uses(spark, sf_dir):
    """Quoted names in build files: even ones beside the file, odd ones from the root."""
    docs = _t(spark, sf_dir, "documents")
    made = docs.select(F.concat("source", F.lit("/f"), "doc_id", F.lit(".c")).alias("path"))
    first = docs.where("source = 'src0'").agg(F.min("doc_id").alias("d")).first().d
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("f"), "doc_id", F.lit(".c"))).otherwise(F.lit(f"/src0/f{first}.c"))
    lines = docs.select(F.concat("source", F.lit("/build")).alias("path"), F.col("doc_id").alias("lno"), F.concat(F.lit("sources = ['"), name, F.lit("']")).alias("text"))
    return producers.file_uses(lines, made).select(F.col("lno").alias("doc_id"), "target")


@query("""SELECT 'P' || p_partkey AS sym, CASE WHEN p_size % 2 = 0 THEN 'binding_to' ELSE 'bound_as' END AS relation, 'cpp' AS lang, 'method' AS kind, 'B' || p_size AS other FROM part""")
def doc_bindings(spark, sf_dir):
    text = F.concat(F.lit("Docs. "), F.when(F.col("p_size") % 2 == 0, "binding_to").otherwise("bound_as"), F.lit("(cpp, method, B"), "p_size", F.lit(")"))
    return producers.doc_bindings(_t(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("sym"), text.alias("documentation")))


@query("""SELECT 'm/' || n_regionkey || '/' || n_nationkey || '.toml' AS path, kind, lno, col, pretty FROM nation, (VALUES ('def', 1::BIGINT, 0::BIGINT, ''), ('use', 1, 17, 'head'), ('use', 2, 2, 'test')) v(kind, lno, col, what),
 LATERAL (SELECT CASE what WHEN '' THEN 'm/' || n_regionkey || '/' || n_nationkey || '.toml' WHEN 'head' THEN 'm/h' || n_nationkey || '.js' ELSE 'm/' || n_regionkey || '/t.js' END AS pretty) WHERE n_nationkey % 4 <> 0""")
def manifest_files(spark, sf_dir):
    """Manifests with a support file above and a test beside them; one in four cannot be parsed."""
    path = F.concat(F.lit("m/"), "n_regionkey", F.lit("/"), "n_nationkey", F.lit(".toml"))
    good = F.concat(F.lit('support-files = "../h'), "n_nationkey", F.lit('.js"\n["t.js"]\n'))
    rows = producers.manifest_files(_t(spark, sf_dir, "nation").select(path.alias("path"), F.when(F.col("n_nationkey") % 4 == 0, "x = [").otherwise(good).alias("text")))
    return rows.select("path", "kind", *_long("lno", "col"), "pretty")


@query("""SELECT 'f' || n_nationkey AS path, 2::BIGINT AS lno, 'nsI' || n_nationkey AS interface, NULL AS member, 'interface' AS member_kind, n_regionkey % 2 = 0 AS scriptable FROM nation
 UNION ALL SELECT 'f' || n_nationkey, 3, 'nsI' || n_nationkey, 'value', 'attribute', n_regionkey % 2 = 0 FROM nation UNION ALL SELECT 'f' || n_nationkey, 4, 'nsI' || n_nationkey, 'run', 'method', n_regionkey % 2 = 0 FROM nation""")
def interface_members(spark, sf_dir):
    start = F.when(F.col("n_regionkey") % 2 == 0, "[scriptable, uuid(1)]\n").otherwise("[uuid(1)]\n")
    text = F.concat(start, F.lit("interface nsI"), "n_nationkey", F.lit(" : nsISupports {\n  readonly attribute long value; // void no();\n  void run(in long a);\n};\n"))
    rows = producers.interface_records(_t(spark, sf_dir, "nation").select(F.concat(F.lit("f"), "n_nationkey").alias("path"), text.alias("text")))
    return rows.select("path", *_long("lno"), "interface", "member", "member_kind", "scriptable")


@query("""SELECT 'XPIDL::I' || p_partkey || '::run' AS sym, 'native' AS slot, 'F_' || p_partkey AS other FROM part WHERE p_size > 10 UNION ALL SELECT 'XPIDL::I' || p_partkey || '::run', 'script', '#run' FROM part WHERE p_size < 30""")
def interface_slots(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    members = part.select(F.concat(F.lit("I"), "p_partkey").alias("interface"), F.lit("run").alias("member"), F.lit("method").alias("member_kind"), (F.col("p_size") < 30).alias("scriptable"))
    symbols = part.where("p_size > 10").select(F.concat(F.lit("F_"), "p_partkey").alias("sym"), F.concat(F.lit("I"), "p_partkey", F.lit("::Run")).alias("pretty"))
    return producers.interface_slots(members, symbols)


@query("SELECT p_partkey, unnest(CASE WHEN p_size < 10 THEN ['#n' || p_size] ELSE ['#n' || p_size, p_brand || '#n' || p_size] END) AS sym FROM part")
def script_names(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") >= 10, F.col("p_brand")).alias("object"), F.concat(F.lit("n"), "p_size").alias("name"))
    return producers.script_names(rows).select("p_partkey", "sym")


@query("""SELECT page_id, unnest(['inline', 'source', 'handler']) AS kind, unnest(['', 'x' || page_id || '.js', 'onclick']) AS value, unnest([0, 1, 2])::BIGINT AS "at" FROM pages""")
def page_scripts(spark, sf_dir):
    html = F.concat(F.lit("<p><script>let a = 1;</script><SCRIPT type='m' src=\"x"), "page_id", F.lit(".js\"></script><b onClick='go()'>go</b>"))
    return producers.page_scripts(_t(spark, sf_dir, "pages").select("page_id", html.alias("html"))).select("page_id", "kind", "value", *_long("at"))


# ---------------------------------------------------------------- tokens and names

_PLAIN = f"""lines AS ({_LINES}), placed AS (SELECT path, lno, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY path ORDER BY lno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines)"""


@query(f"WITH {_PLAIN} SELECT path, start::BIGINT AS start, length(text)::BIGINT AS n FROM placed WHERE text <> '' AND NOT contains(text, chr(13))")
def plain_tokens(spark, sf_dir):
    """One token for each line that is not empty, with its place in the text; line ends are tokens of their own."""
    docs = _t(spark, sf_dir, "documents").where("text is not null").select(source_texts.document_path().alias("path"), "text")
    rows = tokenize.token_table(docs).where("kind = 'plain'")
    return rows.where(~F.contains("token", F.lit("\r"))).select("path", "start", F.char_length("token").cast("bigint").alias("n"))


@query("SELECT p_partkey, p_size % 4 IN (0, 1) AS callable, p_size % 4 = 2 AS class, p_size % 4 = 1 AS lambda, p_size % 4 = 3 AS namespace FROM part")
def symbol_predicates(spark, sf_dir):
    turn = F.col("p_size") % 4
    kind = F.element_at(F.array(*map(F.lit, ("method", "function", "struct", "field"))), (turn + 1).cast("int"))
    pretty = F.when(turn == 1, F.concat(F.lit("a::b(lambda"), "p_size", F.lit(")"))).otherwise("a::b")
    sym = F.when(turn == 3, "NS_a").otherwise("_ZN1aE")
    return _t(spark, sf_dir, "part").select("p_partkey", names.is_callable(kind).alias("callable"), names.is_class(kind).alias("class"), names.is_lambda(pretty).alias("lambda"), names.is_namespace(sym).alias("namespace"))


@query(f"SELECT path FROM (SELECT {_PATH} AS path FROM documents)")
def unmangle_paths(spark, sf_dir):
    return files(spark, sf_dir).select(paths.unmangle(paths.mangle(F.col("path"))).alias("path"))


@query("SELECT p_partkey, 'Map<' || p_size || ', a::b>' AS last, 3::BIGINT AS n FROM part")
def template_names(spark, sf_dir):
    """Names whose template arguments hold separators of their own."""
    part = _t(spark, sf_dir, "part")
    parts = names.segments(F.concat(F.lit("ns::"), F.regexp_replace("p_brand", "#", ""), F.lit("::Map<"), F.col("p_size").cast("string"), F.lit(", a::b>")), F.lit("T_x"))
    return part.select("p_partkey", F.element_at(parts, -1).alias("last"), F.size(parts).cast("bigint").alias("n"))


@query("SELECT o_orderkey, 'Order ' || o_orderkey || ' (' || lower(o_orderpriority) || ') at https://issues.example.org/show?id=' || o_custkey || ', rest ' || CASE WHEN starts_with(o_orderpriority, '1-') THEN substr(o_orderpriority, 3) ELSE '' END || '.' AS text FROM orders")
def render_template(spark, sf_dir):
    template = 'Order {{ key }} ({{ priority | downcase }}) at {{ issue | ensure_bug_url }}, rest {{ priority | strip_prefix_or_empty: "1-" }}{{ nothing }}.'
    columns = {"key": F.col("o_orderkey"), "priority": F.col("o_orderpriority"), "issue": F.col("o_custkey").cast("string")}
    return _t(spark, sf_dir, "orders").select("o_orderkey", templating.render(template, columns).alias("text"))


@query(f"SELECT path, 'txt' AS ext, lang || '/' || source AS compact FROM (SELECT {_PATH} AS path, lang, source FROM documents)")
def path_filters(spark, sf_dir):
    spaced = F.concat(F.col("lang"), F.lit("  /   "), F.col("source"), F.lit("  "))
    return files(spark, sf_dir).select("path", templating.file_extension(F.col("path")).alias("ext"), templating.compact_path(spaced).alias("compact"))


# ---------------------------------------------------------------- revisions


def _versions(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("bigint").alias("rev"), "text")


@query("SELECT conv_id::VARCHAR AS path, max(turn)::BIGINT AS rev, arg_max(md5(text), turn) AS oid FROM conversations WHERE turn <= 2 GROUP BY conv_id")
def files_at_revision(spark, sf_dir):
    return history.at_revision(_versions(spark, sf_dir), 2).select("path", "rev", F.md5(F.encode("text", "UTF-8")).alias("oid"))


@query("""SELECT key, unnest([1, 2, NULL, 3])::BIGINT AS old_lno, unnest([1, NULL, 2, 3])::BIGINT AS new_lno, unnest(['same', 'old' || key, 'new' || key, 'tail']) AS text FROM (SELECT p_partkey::VARCHAR AS key FROM part)""")
def revision_diff(spark, sf_dir):
    """Texts whose middle line changed."""
    side = lambda word: F.concat(F.lit(f"same\n{word}"), F.col("p_partkey").cast("string"), F.lit("\ntail"))
    return history.line_changes(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), side("old").alias("old"), side("new").alias("new"))).select("key", *_long("old_lno", "new_lno"), "text")


@query("SELECT p_size::BIGINT AS rev, 'new' || p_partkey AS path, 'old' || p_partkey AS old_path, 75::BIGINT AS similarity FROM part WHERE p_partkey % 2 = 0")
def renamed_files(spark, sf_dir):
    """Files that go on under another name with one line of four changed; every other one shares nothing with the old."""
    part = _t(spark, sf_dir, "part").withColumn("rev", F.col("p_size").cast("bigint"))
    key = F.col("p_partkey").cast("string")
    old = F.concat(F.lit("a"), key, F.lit("\nb"), key, F.lit("\nc"), key, F.lit("\nd"), key)
    new = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a"), key, F.lit("\nb"), key, F.lit("\nc"), key, F.lit("\nx"), key)).otherwise(F.concat(F.lit("q"), key, F.lit("\nr"), key))
    found = history.renames(part.select("rev", F.concat(F.lit("old"), key).alias("path"), old.alias("text")), part.select("rev", F.concat(F.lit("new"), key).alias("path"), new.alias("text")))
    return found.select("rev", "path", "old_path", *_long("similarity"))


@query("SELECT 'aliases' AS name, count(*) AS n FROM orders UNION ALL SELECT 'blame', count(*) FROM lineitem")
def tree_diagnostics(spark, sf_dir):
    return history.map_counts(aliases=_t(spark, sf_dir, "orders"), blame=_t(spark, sf_dir, "lineitem"))


_MERGED = "SELECT p_partkey::VARCHAR AS path, rev, unnest([1, 2, 3])::BIGINT AS lno, unnest(o) AS orig_rev, unnest([1, 2, 3])::BIGINT AS orig_lno FROM part, (VALUES (1::BIGINT, [1, 1, 1]), (2, [1, 2, 1]), (3, [1, 1, 3]), (4, [1, 2, 3]), (5, [1, 2, 3])) v(rev, o)"


@query(f"SELECT path, rev, lno, orig_rev::BIGINT AS orig_rev, orig_lno FROM ({_MERGED})")
def blame_merged(spark, sf_dir):
    """Two branches that change a line each and are merged; then a revision that is ignored changes all of them."""
    key = F.col("p_partkey").cast("string")
    body = lambda a, b, c: F.concat(F.lit(f"{a}"), key, F.lit(f"\n{b}"), key, F.lit(f"\n{c}"), key)
    made = [(1, [], body("a", "b", "c")), (2, [1], body("a", "x", "c")), (3, [1], body("a", "b", "y")), (4, [2, 3], body("a", "x", "y")), (5, [4], body("A", "X", "Y"))]
    rows = None
    for rev, parents, text in made:
        one = _t(spark, sf_dir, "part").select(key.alias("path"), F.lit(rev).cast("bigint").alias("rev"), text.alias("text"), F.array(*[F.lit(p).cast("bigint") for p in parents]).cast("array<bigint>").alias("parents"))
        rows = one if rows is None else rows.unionByName(one)
    found = history.blame(rows, spark.createDataFrame([(5,)], "rev long"))
    return found.select("path", "rev", *_long("lno"), "orig_rev", *_long("orig_lno"))


@query("SELECT p_partkey::VARCHAR AS path, unnest([1, 2])::BIGINT AS lno, unnest([1, 2])::BIGINT AS orig_rev, unnest(['old' || p_partkey, p_partkey::VARCHAR]) AS orig_path FROM part")
def blame_renamed(spark, sf_dir):
    """A file that was renamed and changed in its second line keeps the first line's origin under the old name."""
    key = F.col("p_partkey").cast("string")
    part = _t(spark, sf_dir, "part")
    first = part.select(F.concat(F.lit("old"), key).alias("path"), F.lit(1).cast("bigint").alias("rev"), F.lit("a\nb").alias("text"), F.lit(None).cast("string").alias("old_path"))
    second = part.select(key.alias("path"), F.lit(2).cast("bigint").alias("rev"), F.lit("a\nc").alias("text"), F.concat(F.lit("old"), key).alias("old_path"))
    found = history.blame(first.unionByName(second)).where("rev = 2")
    return found.select("path", *_long("lno"), "orig_rev", "orig_path")


# ---------------------------------------------------------------- logs, coverage, pages, locations


@query("SELECT event_id FROM events WHERE event_id % 4 <> 0")
def logs_without_bots(spark, sf_dir):
    agent = F.when(F.col("event_id") % 4 == 0, "Some-Crawler/1.0").otherwise("Browser/2")
    return loganalytics.without_bots(_t(spark, sf_dir, "events").withColumn("agent", agent)).select("event_id")


@query("""SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, unnest([1, 2, 3])::BIGINT AS lno, unnest([doc_id % 5, NULL, 0])::BIGINT AS hits FROM documents WHERE lang = 'en'""")
def coverage_report_lines(spark, sf_dir):
    """Nested reports, one for each source, read back as lines; a negative count means that a line cannot be covered."""
    docs = _t(spark, sf_dir, "documents").where("lang = 'en'")
    leaf = F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.array(F.col("doc_id") % 5, F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")).alias("coverage"))
    files_of = docs.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(leaf["name"].alias("k"), F.struct(leaf["coverage"].alias("coverage")).alias("v")))).alias("children"))
    tree = F.to_json(F.struct(F.create_map(F.lit("en"), F.struct(F.create_map("source", F.struct("children")).alias("children"))).alias("children")))
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    files_of.select("source", tree.alias("value")).write.partitionBy("source").text(path)
    found = None
    for r in files_of.select("source").collect():
        one = coverage_report.covered_lines(coverage_report.read_report(spark, f"{path}/source={r.source}"))
        found = one if found is None else found.unionByName(one)
    return found.select("path", *_long("lno", "hits"))


@query("SELECT lang || '/' || source AS path, doc_id AS committed, n_chars::BIGINT AS covered FROM documents WHERE lang = 'en' AND source = 'src1'")
def coverage_history(spark, sf_dir):
    nodes = _t(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("path"), F.col("doc_id").alias("committed"), F.col("n_chars").cast("bigint").alias("covered"))
    return coverage.history(nodes, "en/src1")


@query("SELECT unnest(['N::S' || s_suppkey, 'N']) AS emitted, s_suppkey FROM supplier")
def outline_with_parents(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("N::S"), "s_suppkey").alias("pretty"))
    return history.with_parents(rows).select("emitted", "s_suppkey")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_quantity > 25 THEN 'S' || l_suppkey END AS sym, l_partkey, l_suppkey FROM lineitem")
def tokens_with_records(spark, sf_dir):
    """Tokens and the record that begins at each, if any."""
    items = _t(spark, sf_dir, "lineitem")
    tokens = items.select(F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity").alias("path"), F.col("l_linenumber").alias("lno"), F.lit(4).alias("col"), "l_orderkey", "l_partkey", "l_suppkey")
    records = items.where("l_quantity > 25").select(F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity").alias("path"), F.col("l_linenumber").alias("lno"), F.lit(4).alias("col"), F.concat(F.lit("S"), "l_suppkey").alias("sym"))
    return render.tokens_with_records(tokens, records).select("l_orderkey", F.col("lno").cast("bigint").alias("l_linenumber"), "sym", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, 'see <a href=\"https://x.example/' || o_custkey || '\">https://x.example/' || o_custkey || '</a> and #<a href=\"https://pulls.example.org/' || o_custkey || '\">' || o_custkey || '</a>' AS text FROM orders")
def linkify_addresses(spark, sf_dir):
    text = F.concat(F.lit("see https://x.example/"), F.col("o_custkey").cast("string"), F.lit(" and #"), F.col("o_custkey").cast("string"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", texts.link_pulls(texts.link_urls(text), "https://pulls.example.org/").alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 'def' ELSE 'use' END AS kind FROM part")
def symbol_roles(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", texts.scip_kind(F.col("p_size").cast("int")).alias("kind"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, lpad(l_linenumber::VARCHAR, 5, '0') || ':' || l_linenumber || CASE WHEN l_returnflag = 'A' THEN '' ELSE '-' || (l_linenumber + 3) END AS loc, l_linenumber::BIGINT AS lineno, (CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE l_linenumber + 3 END)::BIGINT AS col_end FROM lineitem")
def location_round_trip(spark, sf_dir):
    start = F.col("l_linenumber").cast("bigint")
    end = F.when(F.col("l_returnflag") == "A", start).otherwise(start + 3)
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", locations.format_location(start, start, end).alias("loc"))
    return rows.withColumn("p", locations.parse_location(F.col("loc"))).select("l_orderkey", "l_partkey", "l_suppkey", "loc", "p.lineno", "p.col_end")


@query("SELECT min(path) AS path, sym FROM (SELECT 'O_' || l_orderkey || '#' || l_linenumber AS path, 'P_' || l_partkey AS sym FROM lineitem WHERE l_returnflag = 'A' AND l_partkey = 7) GROUP BY sym")
def first_definition(spark, sf_dir):
    """The place to which a jump to a symbol's definition leads."""
    found = lookup.definition(_part_hits(spark, sf_dir).withColumn("path", F.concat_ws("#", "path", "lno")), "P_7")
    return found.select("path", "sym")


@query("SELECT 'd' || doc_id || '/x.cpp' AS path, 'd' || doc_id || '/x.h' AS other FROM documents WHERE doc_id % 3 = 0")
def counterpart_files(spark, sf_dir):
    """A source file's header of the same stem, where there is one."""
    docs = _t(spark, sf_dir, "documents")
    stem = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/x"))
    paths_ = docs.select(F.concat(stem, F.lit(".cpp")).alias("path")).unionByName(docs.where("doc_id % 3 = 0").select(F.concat(stem, F.lit(".h")).alias("path")))
    return render.counterpart(paths_, {"cpp": ["h", "hpp"]})

"""Named queries of walks, diagrams, layouts, labels and the older search over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import TypeRules
from ..operators import crossref, graph, history, layout, legacy, lookup, ontology
from ..sources import texts as source_texts
from . import runner
from .catalogue import _FIELDS, _LINES, _PATH, _SUPERS, _TOKENS, _fields, _long, _part_hits, _supers, _t, files, query, targets

_USES = "uses AS (SELECT DISTINCT 'C' || o_custkey AS caller, 'O' || o_orderkey AS sym FROM orders UNION SELECT DISTINCT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem)"


def _named(rows):
    return rows.select("sym", F.col("sym").alias("pretty")).distinct()


def _links(spark, sf_dir):
    """Orders call parts, customers call orders; nations and suppliers are classes below regions; nations hold segments."""
    orders, items = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")

    def use(df, a, x, b, y):
        return df.select(F.concat(F.lit(b), y).alias("sym"), F.lit("uses").alias("relation"), F.concat(F.lit(a), x).alias("other")).distinct().withColumn("kind", F.lit("default")).withColumn("path", F.col("other"))

    uses = use(orders, "C", "o_custkey", "O", "o_orderkey").unionByName(use(items, "O", "l_orderkey", "P", "l_partkey"))
    classes = _supers(spark, sf_dir).select(F.concat(F.lit("T_"), "sym").alias("sym"), F.concat(F.lit("T_"), "super").alias("super"))
    none = F.lit(None).cast("string")
    up = classes.select("sym", F.lit("supers").alias("relation"), F.col("super").alias("other"), F.lit("inheritance").alias("kind"), none.alias("path"))
    down = classes.select(F.col("super").alias("sym"), F.lit("subclasses").alias("relation"), F.col("sym").alias("other"), F.lit("inheritance").alias("kind"), none.alias("path"))
    fields = _t(spark, sf_dir, "customer").select(F.concat(F.lit("T_N"), "c_nationkey").alias("sym"), F.lit("fields").alias("relation"), F.concat(F.lit("T_M_"), "c_mktsegment").alias("other"), F.lit("strong").alias("kind"), none.alias("path")).distinct()
    return uses.unionByName(up).unionByName(down).unionByName(fields).withColumn("ord", F.col("other"))


def graph_index(spark, sf_dir) -> runner.Index:
    links = _links(spark, sf_dir)
    names = _named(links.select("sym").unionByName(links.select(F.col("other").alias("sym"))).unionByName(_fields(spark, sf_dir).select(F.col("cls").alias("sym"))))
    named = names.select("sym", F.concat(F.lit("sym_"), F.regexp_replace("pretty", "^T_", "")).alias("pretty"))
    ids = named.select(F.col("pretty").alias("id"), "sym").withColumn("id_upper", F.upper("id"))
    nothing = spark.createDataFrame([], "sym string, kind string, path string, path_kind string, lno int")
    docs = _t(spark, sf_dir, "documents")
    return runner.Index(files(spark, sf_dir), source_texts.lines(docs), ids, nothing, named, links=links, labels=spark.createDataFrame([("T_N7", graph.STOP["class"])], "sym string, label string"), fields=_fields(spark, sf_dir))


def _up(start: str, depth: int, skip: int) -> str:
    """Callers of callers, through symbols of fewer than ``skip`` uses; a node at the last depth is not walked from."""
    return f"""WITH RECURSIVE {_USES}, many AS (SELECT sym FROM uses GROUP BY sym HAVING count(*) >= {skip}),
 walk(sym, depth) AS (SELECT '{start}', 0 UNION SELECT caller, depth + 1 FROM walk JOIN uses USING (sym) WHERE depth < {depth} AND sym NOT IN (FROM many))"""


@query(f"{_up('P7', 3, 200)} SELECT DISTINCT u.caller AS src, u.sym AS dst, 'default' AS kind FROM uses u JOIN walk w ON u.sym = w.sym WHERE w.depth < 3 AND u.sym NOT IN (FROM many)")
def calls_to_limited(spark, sf_dir):
    return runner.run(graph_index(spark, sf_dir), "calls-to-sym:P7 depth:3 path-limit:200 node-limit:100000")


@query(f"""{_up('P7', 8, 200)}, e AS (SELECT DISTINCT u.caller AS src, u.sym AS dst FROM uses u JOIN walk w ON u.sym = w.sym WHERE u.sym NOT IN (FROM many))
 SELECT a.src, a.dst, 'default' AS kind FROM e a JOIN e b ON a.dst = b.src WHERE a.src = (SELECT min(src) FROM e WHERE src LIKE 'C%') AND b.dst = 'P7'
 UNION SELECT b.src, b.dst, 'default' FROM e a JOIN e b ON a.dst = b.src WHERE a.src = (SELECT min(src) FROM e WHERE src LIKE 'C%') AND b.dst = 'P7'""")
def calls_between_limited(spark, sf_dir):
    """From the first customer, by name, that orders the part to the part."""
    index = graph_index(spark, sf_dir)
    links = index.links
    orders = links.where("sym = 'P7' and relation = 'uses'").select(F.col("other").alias("sym"))
    first = links.where("relation = 'uses'").join(orders, "sym").agg(F.min("other").alias("c")).first().c
    return runner.run(index, f"calls-between-source:'sym_{first}' calls-between-target:sym_P7 path-limit:200 paths-between-node-limit:100000")


_CLASSES = f"c AS (SELECT 'T_' || sym AS sym, 'T_' || super AS super FROM ({_SUPERS})), f AS (SELECT DISTINCT 'T_N' || c_nationkey AS sym, 'T_M_' || c_mktsegment AS other FROM customer)"


@query(f"""WITH {_CLASSES}, n AS (SELECT sym FROM c WHERE super = 'T_R2'), s AS (SELECT c.sym, c.super FROM c JOIN n ON c.super = n.sym WHERE n.sym <> 'T_N7')
 SELECT 'T_R2' AS src, sym AS dst, 'inheritance' AS kind FROM n UNION ALL SELECT super, sym, 'inheritance' FROM s UNION ALL SELECT f.sym, f.other, 'strong' FROM f JOIN n ON f.sym = n.sym WHERE n.sym <> 'T_N7'""")
def class_diagram(spark, sf_dir):
    """Subclasses and fields below a region; one nation bears a stop label."""
    return runner.run(graph_index(spark, sf_dir), "class-diagram:sym_R2 node-limit:100000")


@query(f"WITH {_CLASSES}, up AS (SELECT super FROM c WHERE sym = 'T_N3') SELECT super AS src, 'T_N3' AS dst, 'inheritance' AS kind FROM up UNION ALL SELECT 'T_N3', sym, 'inheritance' FROM c WHERE super = 'T_N3'")
def inheritance_diagram(spark, sf_dir):
    """Up and down from a nation: what was met upwards is walked upwards only."""
    return runner.run(graph_index(spark, sf_dir), "inheritance-diagram:sym_N3 node-limit:100000")


@query(f"SELECT cls, field, greatest(o - coalesce(lag(o + size) OVER (PARTITION BY cls ORDER BY o), 0), 0)::BIGINT AS hole FROM ({_FIELDS}) WHERE cls = (SELECT min(p_brand) FROM part)")
def field_layout_query(spark, sf_dir):
    first = _t(spark, sf_dir, "part").agg(F.min("p_brand").alias("b")).first().b
    return runner.run(graph_index(spark, sf_dir), f"field-layout:'sym_{first}' show-cols:field,hole")


@query(f"""WITH RECURSIVE s AS (SELECT sym AS cls, super AS base, length(sym)::BIGINT AS o FROM ({_SUPERS})),
 w(cls, base, o, depth) AS (SELECT cls, base, o, 1 FROM s UNION ALL SELECT w.cls, s.base, w.o + s.o, depth + 1 FROM w JOIN s ON s.cls = w.base) SELECT cls, base, o AS "offset", depth::BIGINT AS depth FROM w""")
def base_offsets(spark, sf_dir):
    supers = _supers(spark, sf_dir).select(F.col("sym").alias("cls"), F.col("super").alias("base"), F.char_length("sym").cast("bigint").alias("offset"))
    return layout.with_bases(supers).select("cls", "base", "offset", *_long("depth"))


_BITS = "SELECT l_orderkey AS cls, l_linenumber AS field, ((l_linenumber - 1) // 3)::BIGINT AS o, ((l_linenumber - 1) % 3 * 2)::BIGINT AS b, (1 + l_quantity % 2)::BIGINT AS w FROM lineitem"


@query(f"""WITH f AS ({_BITS}), e AS (SELECT *, max(o + ceil((b + w) / 8)::BIGINT) OVER (PARTITION BY cls ORDER BY o, b, w, field ROWS UNBOUNDED PRECEDING) AS "end" FROM f)
 SELECT cls, field::VARCHAR AS field, o AS "offset", greatest(o - coalesce(lag("end") OVER (PARTITION BY cls ORDER BY o, b, w, field), 0), 0)::BIGINT AS hole, "end"::BIGINT AS "end" FROM e""")
def bit_field_holes(spark, sf_dir):
    """Bit-fields share bytes: their end is that of the last byte met."""
    line = F.col("l_linenumber") - 1
    fields = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cls"), F.col("l_linenumber").cast("string").alias("field"), F.floor(line / 3).cast("bigint").alias("offset"), F.lit(1).cast("bigint").alias("size"), (line % 3 * 2).cast("bigint").alias("bit_begin"), (1 + F.col("l_quantity") % 2).cast("bigint").alias("bit_width"))
    return layout.holes(fields)


# ---------------------------------------------------------------- labels


@query("SELECT DISTINCT 'P_' || p_partkey AS sym, 'large' AS label FROM part WHERE p_type IN (SELECT DISTINCT p_type FROM part WHERE p_size > 45)")
def labels_by_name(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    symbols = part.select(F.concat(F.lit("P_"), "p_partkey").alias("sym"), F.col("p_type").alias("pretty"))
    return ontology.labels_by_name(symbols, part.where("p_size > 45").select(F.col("p_type").alias("pretty"), F.lit("large").alias("label")))


@query(f"""WITH RECURSIVE s AS ({_SUPERS}), w(sym) AS (SELECT sym FROM s WHERE super = 'R1' UNION SELECT s.sym FROM w JOIN s ON super = w.sym)
 SELECT 'K' || substr(sym, 2, 1) AS sym, 'holds' AS label FROM w GROUP BY ALL""")
def labels_containing_class(spark, sf_dir):
    """Every class below a region stands within the class of its first digit."""
    supers = _supers(spark, sf_dir)
    syms = supers.select("sym").union(supers.select("super")).distinct()
    digit = F.substring("sym", 2, 1)
    symbols = syms.select("sym", F.concat(F.lit("K"), digit, F.lit("::"), "sym").alias("pretty")).unionByName(syms.select(F.concat(F.lit("K"), digit).alias("sym")).distinct().withColumn("pretty", F.col("sym")))
    roots = spark.createDataFrame([("R1", "holds")], "sym string, label string")
    return ontology.labels_of_containing_class(roots, supers.select(F.col("super").alias("src"), F.col("sym").alias("dst")), symbols)


@query("SELECT DISTINCT 'P_' || p_partkey AS sym, 'traced' AS label FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O' OR l_returnflag = 'N' AND l_linestatus = 'F')")
def labels_field_uses(spark, sf_dir):
    hits = _t(spark, sf_dir, "lineitem").select(F.lit("use").alias("kind"), F.concat("l_returnflag", F.lit("::"), "l_linestatus").alias("context"), F.concat(F.lit("P_"), "l_partkey").alias("sym"))
    fields = _t(spark, sf_dir, "part").select(F.concat(F.lit("P_"), "p_partkey").alias("sym"))
    found = [ontology.labels_of_field_uses(fields, hits, suffix, "traced") for suffix in ("A::O", "N::F")]
    return found[0].unionByName(found[1]).distinct()


@query("SELECT DISTINCT 'N' || s_nationkey AS sym, 'owner' AS label FROM supplier WHERE s_suppkey % 3 = 0")
def labels_owning_class(spark, sf_dir):
    fields = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("owner"), F.concat(F.lit("class K"), (F.col("s_suppkey") % 3).cast("string")).alias("type"))
    return ontology.labels_of_owners(fields, spark.createDataFrame([("K0", "owner")], "pretty string, label string"))


@query(f"""WITH RECURSIVE s AS ({_SUPERS}), w(sym) AS (SELECT 'R1' UNION SELECT s.sym FROM w JOIN s ON super = w.sym)
 SELECT w.sym, 'make' || w.sym AS constructor FROM w WHERE substr(w.sym, 2)::BIGINT IN (SELECT l_suppkey FROM lineitem)""")
def runnable_constructors(spark, sf_dir):
    """Methods that override a root's, with the constructors of their classes that line items use."""
    supers = _supers(spark, sf_dir)
    syms = supers.select("sym").union(supers.select("super")).distinct()
    cls = F.concat(F.lit("ns::"), "sym")
    methods = syms.select("sym", cls.alias("cls"), F.concat(cls, F.lit("::run")).alias("pretty")).unionByName(syms.select(F.concat(F.lit("make"), "sym").alias("sym"), cls.alias("cls"), F.concat(cls, F.lit("::"), "sym").alias("pretty")))
    used = _t(spark, sf_dir, "lineitem").select("l_suppkey").distinct()
    hits = syms.join(used, F.substring("sym", 2, 100).cast("bigint") == used.l_suppkey).select(F.concat(F.lit("make"), "sym").alias("sym"))
    roots = spark.createDataFrame([("R1",)], "sym string")
    return ontology.runnables(roots, supers.select(F.col("super").alias("src"), F.col("sym").alias("dst")), methods, hits)


@query("SELECT 'F' || l_orderkey || '_' || l_linenumber AS field, 'O' || l_orderkey AS owner, CASE l_returnflag WHEN 'A' THEN 'strong' ELSE 'raw' END AS kind, 'T_' || l_partkey AS target FROM lineitem WHERE l_returnflag <> 'N'")
def pointer_fields(spark, sf_dir):
    """What the types of fields point to, by templates and signs."""
    cls = F.concat(F.lit("class ns::P"), F.col("l_partkey").cast("string"))
    kind = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Ref<"), cls, F.lit(">"))).when(F.col("l_returnflag") == "R", F.concat(cls, F.lit(" *"))).otherwise("int")
    items = _t(spark, sf_dir, "lineitem")
    fields = items.select(F.concat(F.lit("O"), "l_orderkey").alias("owner"), F.concat(F.lit("F"), "l_orderkey", F.lit("_"), "l_linenumber").alias("field"), kind.alias("type"))
    symbols = items.select(F.concat(F.lit("ns::P"), "l_partkey").alias("pretty"), F.concat(F.lit("T_"), "l_partkey").alias("sym")).distinct()
    return ontology.pointer_edges(fields, TypeRules(pointers={"Ref": ("strong", 0)}, values={"int"}), symbols).select("owner", "field", "kind", "target")


# ---------------------------------------------------------------- the older search and small joins

_LEGACY_KIND = """CASE WHEN contains(p, '__GENERATED__') THEN 'generated' WHEN starts_with(p, 'third_party/') THEN 'thirdparty' WHEN contains(p, '/unit/') OR contains(p, '/test/') THEN 'test' ELSE 'normal' END"""
_LEGACY_PATHS = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a/__GENERATED__/' WHEN 1 THEN 'third_party/' WHEN 2 THEN 'b/test/' WHEN 3 THEN 'c/unit/' ELSE 'd/latest/' END || source AS p FROM documents"


@query(f"SELECT doc_id, {_LEGACY_KIND} AS path_kind FROM ({_LEGACY_PATHS})")
def legacy_path_kind(spark, sf_dir):
    start = F.element_at(F.array(*map(F.lit, ("a/__GENERATED__/", "third_party/", "b/test/", "c/unit/", "d/latest/"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", legacy.path_kind(F.concat(start, "source")).alias("path_kind"))


@query(f"WITH f AS (SELECT {_PATH} AS path FROM documents), m AS (SELECT path FROM f WHERE regexp_matches(path, '(?i)SRC1')) SELECT path, (SELECT count(*) > 100 FROM m) AS limit_hit FROM m ORDER BY path LIMIT 800")
def legacy_file_search(spark, sf_dir):
    return legacy.search_files(files(spark, sf_dir), "SRC1", limit=100)


@query(f"WITH lines AS ({_LINES}), m AS (SELECT path, lno FROM lines WHERE strlen(text) <= 4096 AND regexp_matches(text, '(?i)the')) SELECT path, lno, (SELECT count(*) > 200 FROM m) AS limit_hit FROM m ORDER BY path, lno LIMIT 200")
def text_matches_limited(spark, sf_dir):
    found = lookup.search_text(source_texts.lines(_t(spark, sf_dir, "documents")), "the")
    return legacy.capped_matches(found.select("path", "lno"), 200).select("path", *_long("lno"), "limit_hit")


@query(f"WITH lines AS ({_LINES}) SELECT path, count(*) AS n, array_to_string(list(lno ORDER BY lno), ',') AS lines FROM lines WHERE strlen(text) <= 4096 AND regexp_matches(text, '(?i)the[a-z]*ou') GROUP BY path")
def text_hits_by_file(spark, sf_dir):
    found = lookup.search_text(source_texts.lines(_t(spark, sf_dir, "documents")), "the[a-z]*ou")
    return crossref.text_hits_by_file(found).select("path", "n", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("SELECT upper(p_brand) AS id_upper, p_brand AS id, 'P_' || p_partkey AS sym FROM part ORDER BY upper(p_brand), p_brand, 'P_' || p_partkey LIMIT 501")
def legacy_identifiers(spark, sf_dir):
    ids = _t(spark, sf_dir, "part").select(F.upper("p_brand").alias("id_upper"), F.col("p_brand").alias("id"), F.concat(F.lit("P_"), "p_partkey").alias("sym"))
    return legacy.first_identifiers(ids)


@query("SELECT p_partkey, p_size AS b0, (p_size + 3)::BIGINT AS b1 FROM part")
def legacy_bounds(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    return part.select("p_partkey", legacy.needle_bounds(F.col("p_size"), "ns::Outer.inr").alias("b")).select("p_partkey", "b.b0", F.col("b.b1").cast("bigint").alias("b1"))


@query("""SELECT 'P_' || l_partkey AS sym, 'normal' AS path_kind, CASE l_returnflag WHEN 'A' THEN 'def' WHEN 'N' THEN 'decl' ELSE 'idl' END AS kind, 'O_' || l_orderkey AS path,
 string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS lines FROM lineitem WHERE l_partkey % 2 = 0 AND starts_with('O_' || l_orderkey, 'O_1') GROUP BY ALL""")
def raw_results(spark, sf_dir):
    symbols = _t(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("P_"), "p_partkey").alias("sym"))
    rows = legacy.raw_results(_part_hits(spark, sf_dir), symbols, "^o_1")
    return rows.select("sym", "path_kind", "kind", "path", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("SELECT p_brand, string_agg(DISTINCT w, ',' ORDER BY w) AS words FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY p_brand")
def merge_comma_lists(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_brand", F.replace("p_type", F.lit(" "), F.lit(",")).alias("words"))
    return legacy.merge_commas(rows, "words", "p_brand")


@query("""WITH h AS (SELECT DISTINCT 'P_' || l_partkey AS sym, 'O_' || l_orderkey AS path FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45)
 SELECT s.sym, h.path FROM (SELECT 'P_' || p_partkey AS sym FROM part) s LEFT JOIN h USING (sym)""")
def symbols_without_hits(spark, sf_dir):
    found = _part_hits(spark, sf_dir).join(_t(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_quantity > 45").select(F.concat(F.lit("P_"), "l_partkey").alias("sym"), F.concat(F.lit("O_"), "l_orderkey").alias("path")).distinct(), ["sym", "path"], "left_semi")
    symbols = _t(spark, sf_dir, "part").select(F.concat(F.lit("P_"), "p_partkey").alias("sym"))
    return crossref.with_all_symbols(found.select("sym", "path").distinct(), symbols)


@query("SELECT page_id AS record_id, 'chrome://' || CASE page_id % 3 WHEN 0 THEN 'a/b/x' || page_id WHEN 1 THEN 'a/y' || page_id ELSE 'z' || page_id END || '.js' AS url FROM pages")
def resolve_relative(spark, sf_dir):
    """Relative addresses in a file that stands at a known address."""
    relative = F.element_at(F.array(F.lit("./x"), F.lit("../y"), F.lit("../../../z")), (F.col("page_id") % 3 + 1).cast("int"))
    records = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), F.concat(F.lit("f"), F.col("page_id") % 2).alias("path"), F.concat(relative, "page_id", F.lit(".js")).alias("relative"))
    urls = spark.createDataFrame([("f0", "chrome://a/b/c.js"), ("f1", "chrome://a/b/d.js")], "path string, url string")
    return crossref.resolve_relative(records, urls)


@query(f"""WITH {_TOKENS}, known AS (SELECT DISTINCT sym FROM targets WHERE pretty = 'the') SELECT path_kind, kind, pretty, path, lno FROM (
 SELECT path_kind, kind, pretty, path, lno, row_number() OVER (PARTITION BY path, lno ORDER BY po, ko, pretty) AS r, po, ko FROM (
 SELECT DISTINCT 'normal' AS path_kind, CASE t.kind WHEN 'def' THEN 'Definitions' ELSE 'Uses' END AS kind, pretty, path, lno, 1 AS po, CASE t.kind WHEN 'def' THEN 2 ELSE 5 END AS ko FROM targets t WHERE pretty = 'the' AND starts_with(path, 'en/src0/')))
 WHERE r = 1 ORDER BY po, ko, pretty, path, lno LIMIT 4000""")
def query_legacy(spark, sf_dir):
    """The older grammar: an exact identifier within a path."""
    marked = targets(spark, sf_dir)
    kinds = files(spark, sf_dir).withColumn("path_kind", F.lit("normal"))
    ids = crossref.identifiers(marked.select("pretty", "sym"), udf=False).withColumn("id_upper", F.upper("id"))
    hits = crossref.hits(marked.withColumn("path_kind", F.lit("normal")), kinds).select("sym", "kind", "path", "path_kind", "lno").distinct()
    index = runner.Index(kinds, source_texts.lines(_t(spark, sf_dir, "documents")), ids, hits, crossref.names(marked))
    return runner.run_legacy(index, "path:en/src0/** id:the").select("path_kind", "kind", "pretty", "path", *_long("lno"))


# ---------------------------------------------------------------- revisions and addresses


@query("SELECT 'a' || o_orderkey AS rev, unnest(['b' || o_custkey, 'c' || o_orderkey]) AS alias FROM orders")
def revision_aliases(spark, sf_dir):
    message = F.concat(F.lit("git a"), "o_orderkey", F.lit(" hg b"), "o_custkey", F.lit(" oldrevs c"), "o_orderkey")
    return history.revision_aliases(_t(spark, sf_dir, "orders").select(message.alias("message")))


@query("SELECT DISTINCT 'r' || n_nationkey AS rev FROM nation WHERE n_regionkey < 3")
def ignored_revisions(spark, sf_dir):
    lines = _t(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") < 3, F.concat(F.lit(" r"), "n_nationkey", F.lit(" # why"))).otherwise("# none").alias("value"))
    return history.ignored_revisions(lines)


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'Both' WHEN o_custkey % 2 = 0 THEN 'Mail' ELSE 'n' || (o_custkey % 3) END AS name,
 CASE WHEN o_custkey % 3 = 0 THEN 'both@x' WHEN o_custkey % 2 = 0 THEN 'mail@x' ELSE 'e' || (o_custkey % 2) END AS email FROM orders""")
def canonical_authors(spark, sf_dir):
    commits = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("n"), F.col("o_custkey") % 3).alias("author_name"), F.concat(F.lit("e"), F.col("o_custkey") % 2).alias("author_email"))
    mailmap = spark.createDataFrame([("n0", "e0", "Both", "both@x"), ("n0", "e1", "Both", "both@x"), (None, "e0", "Mail", "mail@x")], "old_name string, old_email string, name string, email string")
    return history.canonical_authors(commits, mailmap).select("o_orderkey", "name", "email")


@query("SELECT url, CASE WHEN page_id % 2 = 0 THEN 'c/' || page_id ELSE 'z/' || page_id END AS path FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a/' ELSE 'z/' END || page_id AS url FROM pages)")
def url_map(spark, sf_dir):
    """Rewrites follow one another until none fits."""
    urls = _t(spark, sf_dir, "pages").select(F.concat(F.when(F.col("page_id") % 2 == 0, "a/").otherwise("z/"), "page_id").alias("url"))
    return history.map_to_fixpoint(urls, spark.createDataFrame([("a/", "b/"), ("b/", "c/")], "from_prefix string, to_prefix string"))

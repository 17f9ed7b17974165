"""Runs compiled queries over an index, one DataFrame per group, so that Catalyst sees the whole of a flow."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import split_name
from ..functions.paths import escape_regex, glob_to_regex
from ..operators import graph, layout, legacy, lookup, results
from ..sources.records import write_sorted
from ..storage import cut_lineage
from .language import GROUPS, JUNCTIONS, Command, Plan, QueryError, compile_query, parse_legacy, too_short


@dataclass
class Index:
    """What queries run over.

    files: path, path_kind, file_size; lines: path, lno, text; identifiers: id, id_upper, sym; hits: sym, kind, path,
    path_kind, lno; names: sym, pretty; relations: sym, relation, other; edges: src, dst, kind, ord, by edge name;
    links: sym, relation, other, kind, path, ord, what graph walks follow; labels: sym, label; methods: sym, method;
    fields: cls, field, offset, size, bit_begin, bit_width of class layouts.
    """

    files: DataFrame
    lines: DataFrame
    identifiers: DataFrame
    hits: DataFrame
    names: DataFrame
    relations: DataFrame | None = None
    edges: dict[str, DataFrame] | None = None
    links: DataFrame | None = None
    labels: DataFrame | None = None
    methods: DataFrame | None = None
    fields: DataFrame | None = None


#: The key that each stored table is sorted by, so that a lookup or a prefix search prunes files and row groups.
_KEYS = {"files": ("path",), "lines": ("path", "lno"), "identifiers": ("id_upper", "id", "sym"), "hits": ("sym", "path"), "names": ("sym",), "relations": ("sym",), "links": ("sym",), "labels": ("sym",), "methods": ("sym",), "fields": ("cls",)}


def store(index: Index, path: str) -> None:
    """Write an index once, each table dealt and sorted by its key; ``load`` reads it, and queries then build nothing."""
    for name, keys in _KEYS.items():
        table = getattr(index, name)
        if table is not None:
            write_sorted(table, f"{path}/{name}", *keys)
    for name, edges in (index.edges or {}).items():
        write_sorted(edges, f"{path}/edges/{name}", "src")


def load(spark: SparkSession, path: str, edges: tuple[str, ...] = ()) -> Index:
    """A stored index; a table that was not stored is absent."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def read(name: str) -> DataFrame | None:
        at = hadoop(f"{path}/{name}")
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return spark.read.parquet(f"{path}/{name}") if there else None

    return Index(**{name: read(name) for name in _KEYS}, edges={e: t for e in edges if (t := read(f"edges/{e}")) is not None} or None)


def _search(index: Index, commands: list[Command]) -> DataFrame | None:
    """The symbols of a semantic group: sym, rank, pretty, from_ident, relation."""
    found = None
    for c in commands:
        if c.name == "search-identifiers":
            if "add-sym" in c.named:
                raise QueryError("search-identifiers takes no add-sym")
            rows = lookup.search_identifiers(index.identifiers, c.positional, exact="exact-match" in c.bools, types_only="types-only" in c.bools)
            found = rows.groupBy("sym").agg(F.min_by(F.struct("rank", F.col("needle").alias("from_ident")), "rank").alias("q")).select("sym", "q.*")
        elif c.name == "crossref-lookup":
            if found is None:
                found = index.names.where(F.col("sym").isin(c.positional)).select("sym", F.lit(0).alias("rank"), F.lit("").alias("from_ident"))
                if c.positional and "exact-match" in c.bools:
                    found = found.join(index.names.select("sym", F.col("pretty").alias("p")), "sym").select("sym", "rank", F.col("p").alias("from_ident"))
            if "methods" in c.bools and index.methods is not None:
                own = found.join(index.methods, "sym").select(F.col("method").alias("sym"), "rank", "from_ident")
                found = found.join(index.methods.select("sym"), "sym", "left_anti").select("sym", "rank", "from_ident").unionByName(own)
                found, _ = lookup.crossref_lookup(found, index.names)
            else:
                found = cut_lineage(found, "found")  # it is asked for its symbols, then joined twice
                found = cut_lineage(lookup.crossref_lookup(found, _of_few(index.names, found), "exact-match" in c.bools)[0], "known")
            found = found.withColumn("relation", F.lit("Queried"))
        elif c.name == "crossref-expand" and index.relations is not None and found is not None:
            more, _ = graph.expand_relations(found, index.relations)
            ranks = found.select(F.col("sym").alias("root"), "rank", "from_ident")
            found = more.join(ranks, "root").join(index.names, "sym").select("sym", "rank", "from_ident", "pretty", "relation")
    return found


def _int(command: Command, name: str, default: int) -> int:
    return int(command.named[name][0]) if name in command.named else default


def run(index: Index, query: str | Plan) -> DataFrame:
    """The result of a query: ordered rows of hits, lines with context, or edges of a graph."""
    plan = compile_query(query) if isinstance(query, str) else query
    made: dict[str, DataFrame] = {}
    for phase in plan.phases:
        for name in phase["groups"]:
            made[GROUPS[name].output] = _group(index, name, plan.groups[name], made.get(plan.inputs[name] or ""), made)
        for name in phase["junctions"]:
            command, output, _ = JUNCTIONS[name]
            parts = {i: made[i] for i in plan.junctions[name] if i in made}
            made[output] = _compile(index, parts) if command == "compile-results" else lookup.fuse(parts)
    if "result" not in made:
        raise QueryError("the query gives no result")
    return made["result"]


def _group(index: Index, name: str, commands: list[Command], given: DataFrame | None, made: dict[str, DataFrame]) -> DataFrame | None:
    if name == "file-search":
        c = commands[0]
        return lookup.search_files(index.files, c.positional[0] if c.positional else None, c.named["pathre"][0] if "pathre" in c.named else None)
    if name == "text-search":
        c = commands[0]
        if "re" not in c.named:
            return lookup.search_text(index.lines.where("false"), "x")
        return lookup.search_text(index.lines, c.named["re"][0], c.named["pathre"][0] if "pathre" in c.named else None, "case-sensitive" in c.bools)
    if name.startswith(("semantic-search", "semantic-lookup", "graph-symbols")):
        return _search(index, commands)
    if name == "graph-traverse":
        if given is None:
            raise QueryError("the query names no symbol to walk from")
        return _traverse(index, commands[0], given)
    if name == "graph-render":
        return _render(index, next(c for c in commands if c.name == "graph"), given)
    if name == "semantic-format":
        return _format(index, next((c for c in commands if c.name == "format-symbols"), Command("format-symbols")), given)
    if name == "display" and given is not None and commands and "before" in commands[0].named:
        before, after = _int(commands[0], "before", 0), _int(commands[0], "after", 0)
        shown = results.with_context(given.where("l0 > 0"), index.lines, before, after)
        return given.join(shown.select("path", "l0", F.col("lno").alias("shown_lno"), F.col("text").alias("shown")), ["path", "l0"], "left")
    return given


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _value(command: Command, name: str, default: str = "") -> str:
    return command.named[name][0] if name in command.named else default


def _traverse(index: Index, c: Command, given: DataFrame) -> DataFrame:
    """src, dst, kind: the edges of a walk under the command's limits."""
    mode, between = _value(c, "edge", "callees"), "paths-between" in c.bools
    limit = _int(c, "paths-between-node-limit", graph.PATH_NODE_LIMIT) if between else _int(c, "node-limit", graph.NODE_LIMIT)
    depth = _int(c, "max-depth", graph.MAX_DEPTH) or graph.MAX_DEPTH
    # More seeds than the limit on nodes would stop the walk at its first step.
    seeds = given.groupBy("sym").agg(F.min("flags").alias("least"), F.max("flags").alias("most")).orderBy("sym").limit(limit + 1).collect()
    sources, targets = {r.sym for r in seeds if r.least < 2}, {r.sym for r in seeds if r.least != 1 or r.most != 1}
    schema = "src string, dst string, kind string"
    spark = index.names.sparkSession
    if index.links is None:
        edges = (index.edges or {}).get(mode)
        if edges is None:
            raise QueryError("the index has no such edges")
        if between:
            ends = given.where("flags <> 1")
            return graph.path_edges(graph.paths_between(given.where("flags <> 2"), ends, edges, depth + 2)).withColumn("kind", F.lit("default"))
        return graph.traverse(given, edges, depth)[1].select("src", "dst", "kind").distinct()
    met = graph.walk(
        [r.sym for r in seeds if r.sym in targets],
        index.links,
        mode,
        index.labels,
        index.names,
        max_depth=depth,
        node_limit=limit,
        skip_uses_at=_int(c, "skip-uses-at-path-count", graph.SKIP_USES),
        ignore=frozenset(_names(_value(c, "ignore-nodes"))),
        member_uses_depth=_int(c, "traverse-field-member-uses", 0),
    )
    kept = list(met.edges)
    if between:
        kept = graph.edges_between(kept, sources, targets, depth, limit)
    return spark.createDataFrame([(a, b, met.edges[a, b]) for a, b in kept], schema)


def _render(index: Index, c: Command, given: DataFrame) -> DataFrame:
    """The graph's edges, or one row with its text in a format; ``hier`` adds the tree that names span."""
    form = _value(c, "format", "bundle")
    if form not in ("bundle", "json", "dot"):
        raise QueryError(f"graph format {form} is drawn by the client")
    if form == "bundle" and "hier" not in c.named:
        return given
    edges = [(r.src, r.dst, r.kind) for r in given.limit(graph.PATH_NODE_LIMIT * graph.MAX_DEPTH).collect()]
    syms = sorted({s for a, b, _ in edges for s in (a, b)})
    pretty = {r.sym: r.pretty for r in index.names.where(F.col("sym").isin(syms)).collect()}
    if form == "dot":
        text = graph.to_dot(edges, pretty, tuple(_names(_value(c, "colorize-callees"))))
    else:
        whole = {"graph": graph.to_json(edges), "pretty": {s: pretty.get(s, s) for s in syms}}
        if _value(c, "hier", "flat") != "flat":
            whole["tree"] = graph.hierarchy([(s, split_name(pretty.get(s, s), s)[0]) for s in syms])
        text = json.dumps(whole, sort_keys=True)
    return index.names.sparkSession.createDataFrame([(form, text)], "format string, text string")


def _format(index: Index, c: Command, given: DataFrame) -> DataFrame:
    """The fields of the symbols' classes with the holes between them; columns as asked for."""
    if _value(c, "mode") != "field-layout" or index.fields is None:
        return given
    rows = layout.holes(index.fields.join(given.select(F.col("sym").alias("cls")).distinct(), "cls", "left_semi"))
    shown, hidden = _names(_value(c, "show-cols")), _names(_value(c, "hide-cols"))
    return rows.select(*[x for x in rows.columns if x == "cls" or (not shown or x in shown) and x not in hidden])


def run_legacy(index: Index, query: str) -> DataFrame:
    """The older search: path_kind, kind, pretty, path, lno of one page, each line once.

    A query of parts that are all too short gives nothing.
    """
    terms = parse_legacy(query)
    empty = index.hits.where("false").select("path_kind", "kind", F.lit(0).alias("rank"), F.lit("").alias("pretty"), "path", "lno")
    path = terms["pathre"] if "pathre" in terms else glob_to_regex(terms["path"]) if "path" in terms else None
    words = {k: v for k, v in terms.items() if k in ("id", "default", "symbol", "re", "text")}
    if not words or too_short(words):
        return results.legacy_compile(empty)
    rows = empty
    needle = terms.get("id") or terms.get("default")
    if "symbol" in terms:
        found = index.names.where(F.col("sym").isin(_names(terms["symbol"])))
    elif needle:
        ids = lookup.search_identifiers(index.identifiers, [needle], exact="id" in terms, limit=legacy.IDENTIFIERS)
        found = cut_lineage(ids.groupBy("sym").agg(F.min("rank").alias("rank")), "found")
        found = cut_lineage(found.join(_of_few(index.names, found), "sym"), "known")
    if "symbol" in terms or needle:
        hits = _of_few(index.hits, found).join(found.select("sym", "pretty"), "sym").where(F.col("kind").isin(*results.KINDS_SHOWN))
        rows = rows.unionByName(hits.select("path_kind", results.presentation(F.col("kind")).alias("kind"), F.lit(0).alias("rank"), "pretty", "path", "lno"))
    pattern = terms.get("re") or escape_regex(terms.get("text") or terms.get("default") or "")
    if pattern and "id" not in terms and "symbol" not in terms:
        text = lookup.search_text(index.lines, pattern).join(index.files.select("path", "path_kind"), "path")
        rows = rows.unionByName(text.select("path_kind", F.lit("TextualOccurrences").alias("kind"), F.lit(0).alias("rank"), F.lit("").alias("pretty"), "path", "lno"))
    if "default" in terms:
        named = lookup.search_files(index.files, regex=f"(?iu){escape_regex(terms['default'])}").select("path_kind", F.lit("Files").alias("kind"), F.lit(0).alias("rank"), F.lit("").alias("pretty"), "path", F.lit(0).alias("lno"))
        rows = named.unionByName(rows)
    return results.legacy_compile(rows if path is None else rows.where(F.col("path").rlike(f"(?iu){path}")))


def _of_few(table: DataFrame, symbols: DataFrame) -> DataFrame:
    """The rows of the symbols found.  A search gives few, so the scan gets them as a list to prune by; many are joined."""
    few = [r.sym for r in symbols.select("sym").distinct().limit(lookup.IDENTIFIERS + 1).collect()]
    return table.where(F.col("sym").isin(few)) if len(few) <= lookup.IDENTIFIERS else table


def _hits_of(index: Index, symbols: DataFrame) -> DataFrame:
    """Hits of the symbols found."""
    found = symbols.select("sym", "rank", "pretty")
    return _of_few(index.hits, found).join(found, "sym")


def _compile(index: Index, parts: dict[str, DataFrame]) -> DataFrame:
    """Files, semantic hits and text hits in one table."""
    empty = index.hits.where("false")
    symbols = parts.get("semantic-search")
    hits = empty.select("sym", "kind", "path", "path_kind", "lno", F.lit(0).alias("rank"), F.lit("").alias("pretty")) if symbols is None else _hits_of(index, symbols)
    semantic = results.semantic_results(hits.withColumn("peek_first", F.lit(None).cast("int")).withColumn("peek_last", F.lit(None).cast("int")))
    text = parts.get("text-search")
    kinds = index.files.select("path", "path_kind")
    text = empty.select("path_kind", "path", "lno") if text is None else text.join(kinds, "path", "left").select(F.coalesce("path_kind", F.lit("")).alias("path_kind"), "path", "lno")
    rows = results.compile_results(semantic, text)
    if "file-search" in parts:
        found = parts["file-search"].select("path_kind", F.lit("Files").alias("kind"), F.lit(0).alias("rank"), F.lit("").alias("pretty"), "path", F.lit(0).alias("l0"), F.lit(0).alias("l1"), F.lit(-1).alias("kind_ord"), F.lit(1).alias("line_ord"))
        rows = found.unionByName(rows)
    return results.presented(rows)

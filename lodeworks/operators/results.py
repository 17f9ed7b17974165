"""Result compilation: kinds of hits, text hits that add nothing, lines with context, facets, precedence and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups of a result in order (fixed order).
PRESENTATION = ["IDL", "IDLPartial", "Definitions", "Declarations", "Assignments", "Uses", "TextualOccurrences"]
_OF_KIND = {"idl": "IDL", "idlp": "IDLPartial", "def": "Definitions", "decl": "Declarations", "assign": "Assignments", "use": "Uses"}
#: Kinds of hits that results show.
KINDS_SHOWN = list(_OF_KIND)
PATH_KINDS = ["normal", "thirdparty", "test", "generated"]
LINE_CAP = 4000
RELATED = 100


def presentation(kind: F.Column) -> F.Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in _OF_KIND.items() for x in pair]), kind)


def kind_order(column: F.Column) -> F.Column:
    return F.array_position(F.array(*map(F.lit, PRESENTATION)), column) - 1


def semantic_results(hits: DataFrame) -> DataFrame:
    """path_kind, kind, rank, pretty, path, l0, l1 of hits (sym, kind, rank, pretty, path, path_kind, lno, and peek lines)."""
    shown = hits.where(F.col("kind").isin(*_OF_KIND))
    return shown.select("path_kind", presentation(F.col("kind")).alias("kind"), "rank", "pretty", "path", F.coalesce("peek_first", "lno").alias("l0"), F.coalesce("peek_last", "lno").alias("l1"), "lno")


def compile_results(semantic: DataFrame, text: DataFrame) -> DataFrame:
    """Semantic rows and those text hits whose line no semantic row has, each line once.

    ``kind_ord`` orders the kinds; ``line_ord`` numbers the rows of a group, a file's lines of one kind and name, in
    parallel.  ``presented`` puts the rows into the order of a result page.
    """
    taken = semantic.select("path", "lno").distinct()
    extra = text.select("path_kind", "path", "lno").distinct().join(taken, ["path", "lno"], "left_anti")
    extra = extra.select("path_kind", F.lit("TextualOccurrences").alias("kind"), F.lit(0).alias("rank"), F.lit("").alias("pretty"), "path", F.col("lno").alias("l0"), F.col("lno").alias("l1"))
    rows = semantic.select("path_kind", "kind", "rank", "pretty", "path", "l0", "l1").distinct().unionByName(extra)
    key = ["path_kind", "kind", "rank", "pretty", "path"]
    return rows.withColumn("kind_ord", kind_order(F.col("kind")).cast("int")).withColumn("line_ord", F.row_number().over(Window.partitionBy(*key).orderBy("l0", "l1")))


def presented(rows: DataFrame) -> DataFrame:
    """Compiled rows in order of kind of path, kind, rank, name, path and line."""
    return rows.orderBy(F.array_position(F.array(*map(F.lit, PATH_KINDS)), F.col("path_kind")), "path_kind", "kind_ord", "rank", "pretty", "path", "line_ord")


def with_context(spans: DataFrame, lines: DataFrame, before: int, after: int) -> DataFrame:
    """path, l0, lno, text: each span's lines with those around it, without running into the spans before and after."""
    w = Window.partitionBy("path").orderBy("l0", "l1")
    clipped = spans.select("path", "l0", "l1").distinct().select(
        "path",
        "l0",
        F.greatest(F.lit(1), F.col("l0") - before, F.coalesce(F.lag("l1").over(w) + 1, F.lit(1))).alias("first"),
        F.least(F.col("l1") + after, F.coalesce(F.lead("l0").over(w) - 1, F.col("l1") + after)).alias("last"),
    )
    each = clipped.where("first <= last").select("path", "l0", F.explode(F.sequence("first", "last")).alias("lno"))
    return each.join(lines, ["path", "lno"])


def relation_facet(rows: DataFrame, ways: str | None = None) -> DataFrame:
    """How many results each relation to the query gives; a row counts once, or as often as its column ``ways`` says."""
    label = F.when(F.col("relation") == "Queried", "Self").when(F.col("relation") == "OverrideOf", "Overriden By").when(F.col("relation") == "OverriddenBy", "Overrides").when(F.col("relation") == "CousinOverrideOf", "Cousin Overrides").otherwise(F.col("relation"))
    return rows.groupBy(label.alias("facet")).agg((F.sum(ways) if ways else F.count("*")).alias("n"))


def path_counts(rows: DataFrame) -> DataFrame:
    """dir, n: rows below each directory, on every level."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return rows.where(F.size(parts) > 1).select(F.explode(ancestors).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))


def path_facet(counts: dict[str, int], clump: int = 3) -> list[dict]:
    """The facet tree of directory counts: one child folds into its parent, small leftovers share ``*``.

    No facet (an empty list) if there is but one way to go.
    """

    def below(prefix: str) -> list[str]:
        start = f"{prefix}/" if prefix else ""
        return sorted(d for d in counts if d.startswith(start) and d != prefix and "/" not in d[len(start) :])

    def node(path: str) -> dict:
        label = path.rsplit("/", 1)[-1]
        kids = below(path)
        while len(kids) == 1 and counts[kids[0]] == counts[path]:
            path = kids[0]
            label, kids = f"{label}/{path.rsplit('/', 1)[-1]}", below(path)
        return {"label": label, "path": path, "count": counts[path], "children": group(kids)}

    def group(kids: list[str]) -> list[dict]:
        large = [node(k) for k in kids if counts[k] >= clump]
        small = [k for k in kids if counts[k] < clump]
        if small:
            large.append({"label": "*", "path": None, "count": sum(counts[k] for k in small), "children": []})
        return large

    top = group(below(""))
    return top if len(top) > 1 or any(len(t["children"]) > 1 for t in top) else []


def legacy_compile(rows: DataFrame, cap: int = LINE_CAP) -> DataFrame:
    """Rows (path_kind, kind, path, lno): each line once, by kind of path, then kind; then the first ``cap`` of all.

    The cap is a top-k over the whole order, which each task cuts before rows meet.
    """
    kind_ord = kind_order(F.col("kind"))
    pathkind_ord = F.array_position(F.array(*map(F.lit, PATH_KINDS)), F.col("path_kind"))
    w = Window.partitionBy("path", "lno").orderBy("po", "ko", "pretty")
    once = rows.withColumn("po", pathkind_ord).withColumn("ko", kind_ord).withColumn("r", F.row_number().over(w)).where("r = 1")
    return once.orderBy("po", "ko", "pretty", "path", "lno").limit(cap).select("path_kind", "kind", "pretty", "path", "lno")


def related_definitions(related: DataFrame, hits: DataFrame, limit: int = RELATED) -> DataFrame:
    """sym, relation, path, lno: definitions of related symbols; a relation of ``limit`` symbols or more is left out."""
    few = related.groupBy("sym", "relation").agg(F.count("*").alias("n")).where(F.col("n") < limit)
    return related.join(few, ["sym", "relation"], "left_semi").join(hits.where("kind = 'def'").select(F.col("sym").alias("other"), "path", "lno"), "other").select("sym", "relation", "other", "path", "lno")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side they are on."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))

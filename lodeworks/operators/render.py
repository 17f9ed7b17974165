"""What pages show: lines zipped with their blame and coverage, excerpts, masked text, files written per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What changes from run to run, and what stands for it (in this order).
UNSTABLE = [
    (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?", "DATE"),
    (r"\b[0-9a-f]{40}\b", "REVISION"),
    (r'(data-blame|data-line-number|id="l)(="?|-)?[^" >]*', "$1"),
    (r"\bline [0-9]+", "line N"),
]


def mask_unstable(text: Column) -> Column:
    """The text with dates, revisions, line numbers and blame attributes masked."""
    for pattern, instead in UNSTABLE:
        text = F.regexp_replace(text, pattern, instead)
    return text


def strip_tags(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags, white space run together."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def elements(html: Column, tag: str) -> Column:
    """The inner markup of every element of a kind that holds none of its kind."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>((?:(?!<{tag}\b).)*?)</{tag}\s*>"), F.lit(1))


def file_page(lines: DataFrame, blame: DataFrame | None = None, coverage: DataFrame | None = None) -> DataFrame:
    """path, lno, text with the line's origin and hits where known."""
    out = lines
    if blame is not None:
        out = out.join(blame.select("path", "lno", "orig_rev", "orig_lno"), ["path", "lno"], "left")
    if coverage is not None:
        out = out.join(coverage.select("path", "lno", "hits"), ["path", "lno"], "left")
    return out


def excerpts(lines: DataFrame, places: DataFrame) -> DataFrame:
    """The lines that records name, each once."""
    return lines.join(places.select("path", "lno").distinct(), ["path", "lno"], "left_semi")


def tokens_with_records(tokens: DataFrame, records: DataFrame) -> DataFrame:
    """Tokens (path, lno, col) with the record that begins there, if any."""
    return tokens.join(records, ["path", "lno", "col"], "left")


def dictify(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One map of JSON values by key, per ``group``."""
    return rows.groupBy("group").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("json"))


def write_groups(rows: DataFrame, group: str, path: str) -> None:
    """One folder of files per group."""
    rows.repartition(group).sortWithinPartitions(group).write.mode("overwrite").partitionBy(group).json(path)


def counterpart(paths: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """path, other: the first file of the same stem whose extension an extension's list names."""
    rules = [(ext, i, other) for ext, others in families.items() for i, other in enumerate(others)]
    dim = paths.sparkSession.createDataFrame(rules, "ext string, prio int, other_ext string")
    stem, ext = F.regexp_extract("path", r"^(.*)\.[^./]+$", 1), F.regexp_extract("path", r"\.([^./]+)$", 1)
    keyed = paths.select("path", stem.alias("stem"), ext.alias("ext"))
    pairs = keyed.join(dim, "ext").join(keyed.select("stem", F.col("ext").alias("other_ext"), F.col("path").alias("other")), ["stem", "other_ext"])
    return pairs.groupBy("path").agg(F.min_by("other", "prio").alias("other"))

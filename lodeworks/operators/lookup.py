"""Searches and lookups: identifiers, files, text, cross-reference rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dirname, glob_to_regex, natural_key
from ..sources.texts import LINE_LIMIT

#: Results of an identifier search, per needle.
IDENTIFIERS = 1000
MIN_NEEDLE_BYTES = 3
FILES = 2000
#: What a file search without a limit is cut to.
ALL_FILES = 2_000_000
#: Orders after every character that an identifier holds.
_LAST = "~"


def search_identifiers(identifiers: DataFrame, needles: list[str], exact: bool = False, case_sensitive: bool = False, types_only: bool = False, min_length: int = MIN_NEEDLE_BYTES, limit: int = IDENTIFIERS) -> DataFrame:
    """needle, id, sym, rank of identifiers that begin with a needle, without another ``:`` or ``.`` after it.

    ``identifiers`` holds id, id_upper, sym.  A needle is one range of ``id_upper``, which the scan prunes by.  Rank 0 is
    an exact match, 1 one but for case, then 2 and the number of characters left.
    """
    found = None
    for needle in needles:
        if len(needle.encode()) < min_length:
            continue
        low = needle.upper()
        rest = F.substring("id", len(needle) + 1, 1_000_000)
        rank = F.when(F.col("id") == needle, 0).when(F.col("id_upper") == low, 1).otherwise(2 + F.char_length(rest))
        keep = F.col("id_upper").between(low, low + _LAST) & F.col("id_upper").startswith(low) & ~rest.rlike("[:.]")
        keep &= (F.char_length(rest) == 0) if exact else F.lit(True)
        keep &= F.col("id").startswith(needle) if case_sensitive else F.lit(True)
        keep &= F.col("sym").startswith("T_") if types_only else F.lit(True)
        one = identifiers.where(keep).select(F.lit(needle).alias("needle"), "id", "sym", rank.alias("rank")).orderBy(F.upper("id"), "id", "sym").limit(limit)
        found = one if found is None else found.unionByName(one)
    return identifiers.where("false").select(F.lit("").alias("needle"), "id", "sym", F.lit(0).alias("rank")) if found is None else found


def complete(identifiers: DataFrame, prefix: str, n: int = 6) -> DataFrame:
    """The first identifiers that begin so, in their case."""
    return search_identifiers(identifiers, [prefix], case_sensitive=True, min_length=0, limit=n)


def search_files(files: DataFrame, glob: str | None = None, regex: str | None = None, limit: int = FILES) -> DataFrame:
    """Files whose path holds the pattern, first in natural order; a regular expression wins over a glob, 0 means no limit."""
    pattern = regex if regex is not None else glob_to_regex(glob or "")
    return files.where(F.col("path").rlike(pattern)).orderBy(natural_key(F.col("path")), "path").limit(limit or ALL_FILES)


def group_by_directory(files: DataFrame) -> DataFrame:
    return files.groupBy(dirname(F.col("path")).alias("dir")).agg(F.count("*").alias("n_files"), F.sum("file_size").alias("total_size"))


def by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext")).agg(F.count("*").alias("n_files"))


def search_text(lines: DataFrame, pattern: str, path: str | None = None, case_sensitive: bool = False, limit: int = 0) -> DataFrame:
    """path, lno, bounds of the first match, text: lines that hold the pattern, in order of places if limited.

    Long lines are not searched.  Letter case is folded for all scripts.
    """
    regex = pattern if case_sensitive else f"(?iu){pattern}"
    found = lines.where((F.octet_length("text") <= LINE_LIMIT) & F.col("text").rlike(regex))
    if path is not None:
        found = found.where(F.col("path").rlike(path))
    start = F.regexp_instr("text", F.lit(regex)) - 1
    out = found.select("path", "lno", start.alias("b0"), (start + F.char_length(F.regexp_substr("text", F.lit(regex)))).alias("b1"), "text")
    return out.orderBy("path", "lno").limit(limit) if limit else out


def crossref_lookup(symbols: DataFrame, table: DataFrame, exact_pretty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of known symbols, and the symbols without one.  ``exact_pretty``: the name must be the identifier asked for."""
    known = symbols.join(table, "sym")
    if exact_pretty:
        known = known.where(F.lower("pretty") == F.lower("from_ident"))
    return known, symbols.join(table.select("sym"), "sym", "left_anti")


def expand_methods(symbols: DataFrame, methods: DataFrame) -> DataFrame:
    """Each class replaced by its methods; other symbols stay."""
    own = symbols.join(methods, "sym", "left")
    return own.select(F.coalesce("method", "sym").alias("sym")).distinct()


def jumpref_lookup(symbols: DataFrame, jumprefs: DataFrame) -> DataFrame:
    """One row per symbol asked for; a miss stays, with nulls."""
    return symbols.join(jumprefs, "sym", "left")


def fuse(inputs: dict[str, DataFrame]) -> DataFrame:
    """All inputs' rows, duplicates too; those of ``source`` and ``target`` bear flag 1 and 2, others 0."""
    out = None
    for name, df in inputs.items():
        one = df.withColumn("flags", F.lit({"source": 1, "target": 2}.get(name, 0)))
        out = one if out is None else out.unionByName(one)
    return out


def definition(hits: DataFrame, sym: str) -> DataFrame:
    """The first definition of a symbol."""
    return hits.where((F.col("sym") == sym) & (F.col("kind") == "def")).orderBy("path", "lno").limit(1)


def containing_ranges(lines: DataFrame, ranges: DataFrame, bucket: int = 64) -> DataFrame:
    """Range join: each line (path, lno) with the ranges (path, first, last) around it.

    Both sides are cut to buckets of line numbers, so the join is an equi join; a range visits each bucket it spans.
    """
    spread = ranges.withColumn("b", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor(F.col("last") / bucket))))
    return lines.withColumn("b", F.floor(F.col("lno") / bucket)).join(spread, ["path", "b"]).where("lno between first and last").drop("b")


def nesting_depth(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """path, lno, depth: how many ranges of several lines are open at each line."""
    inside = containing_ranges(lines, ranges.where("last > first")).groupBy("path", "lno").agg(F.count("*").alias("depth"))
    return lines.select("path", "lno").join(inside, ["path", "lno"], "left").select("path", "lno", F.coalesce("depth", F.lit(0)).alias("depth"))


def sticky_ranges(ranges: DataFrame) -> DataFrame:
    """path, lno, sym, pops: the lines on which a nested range opens (its symbol, of several the last) or ranges close.

    ``ranges``: path, lno and col of a symbol, sym, and first, last line of what it encloses.  A range opens if none is
    open, or if it begins on this line or later, not where the innermost open one began, and ends past the next line.  At
    the end of a line the innermost ranges close whose last line is not beyond the next.  A file is one bounded group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, stack = [], []
        ordered = pdf.where(pdf.notna(), None).sort_values(["lno", "col"], kind="stable")
        by_line = {lno: list(zip(g["sym"], g["first"], g["last"], strict=True)) for lno, g in ordered.groupby("lno")}
        ends = sorted({int(x) - 1 for x in pdf["last"].dropna()})
        for lno in sorted({*by_line, *ends}):
            opened = None
            for sym, first, last in by_line.get(lno, []):
                if first and (not stack or first >= lno and first != stack[-1][0] and last > lno + 1):
                    stack.append((first, last))
                    opened = sym
            keep = next((i + 1 for i in reversed(range(len(stack))) if stack[i][1] - 1 > lno), 0)
            pops = len(stack) - keep
            del stack[keep:]
            if opened is not None or pops:
                rows.append((pdf["path"].iloc[0], int(lno), opened, pops))
        return pd.DataFrame(rows, columns=["path", "lno", "sym", "pops"])

    return ranges.select("path", "lno", "col", "sym", "first", "last").groupBy("path").applyInPandas(run, "path string, lno int, sym string, pops int")


def numbered(df: DataFrame, keys: list[Column], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

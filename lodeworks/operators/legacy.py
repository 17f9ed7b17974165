"""The older search page: file and identifier searches with their caps, kinds of paths by fixed words, raw results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers of a search that are looked up, at most.
IDENTIFIERS = 501
#: Files of a search: more set ``limit_hit``; eight times as many are given on for later filters.
FILES = 4000
BEFORE_FILTERS = 8
#: Matches of a text search; more set ``limit_hit``.
MATCHES = 4000

# What makes a path a test.
TEST_PARTS = ["/test/", "/tests/", "/mochitest/", "testing/", "/jsapi-tests/", "/reftests/", "/reftest/", "/crashtests/", "/crashtest/", "/googletest/", "/gtest/", "/gtests/", "/imptests/"]
TEST_ANYWAY = ["/unit/", "/androidTest/"]
TEST_STARTS = ["LayoutTests/"]
GENERATED, THIRD_PARTY = "__GENERATED__", "third_party/"


def path_kind(path: Column) -> Column:
    """generated, thirdparty, test or normal, by words of the path."""
    test = F.lit(False)
    for part in TEST_PARTS + TEST_ANYWAY:
        test |= F.contains(path, F.lit(part))
    for start in TEST_STARTS:
        test |= F.startswith(path, F.lit(start))
    return F.when(F.contains(path, F.lit(GENERATED)), "generated").when(F.startswith(path, F.lit(THIRD_PARTY)), "thirdparty").when(test, "test").otherwise("normal")


def _capped(rows: DataFrame, order: list[str], given: int, hit: int) -> DataFrame:
    """The first ``given`` rows, each task cutting its own first, and ``limit_hit`` if there are more than ``hit``."""
    many = rows.limit(hit + 1).count() > hit
    return rows.orderBy(*order).limit(given).withColumn("limit_hit", F.lit(many))


def search_files(files: DataFrame, pattern: str, limit: int = FILES, before_filters: int = BEFORE_FILTERS) -> DataFrame:
    """path, limit_hit of files whose path holds the pattern in either case; ``limit_hit`` on every row."""
    return _capped(files.where(F.col("path").rlike(f"(?iu){pattern}")).select("path"), ["path"], limit * before_filters, limit)


def capped_matches(matches: DataFrame, limit: int = MATCHES) -> DataFrame:
    """The first matches (path, lno, ...) by place, and whether there are more."""
    return _capped(matches, ["path", "lno"], limit, limit)


def first_identifiers(found: DataFrame, cap: int = IDENTIFIERS) -> DataFrame:
    """The identifiers that a search looks up."""
    return found.orderBy(F.upper("id"), "id", "sym").limit(cap)


def needle_pieces(needle: str) -> list[str]:
    return re.split(r"\.|::", re.sub(r"\\(.)", r"\1", needle))


def needle_bounds(start: Column, needle: str) -> Column:
    """Bounds of a hit cut to what the needle's last piece covers."""
    return F.struct(start.alias("b0"), (start + len(needle_pieces(needle)[-1])).alias("b1"))


def raw_results(hits: DataFrame, symbols: DataFrame, path: str | None = None) -> DataFrame:
    """sym, path_kind, kind, path, lines: all hits of symbols by kind of path, kind and path.

    ``path`` is a pattern in either case; what is no pattern is taken literally.
    """
    found = hits.join(symbols.select("sym").distinct(), "sym").withColumn("path_kind", path_kind(F.col("path")))
    if path and path != ".*":
        try:
            re.compile(path)
        except re.error:
            path = re.escape(path)
        found = found.where(F.col("path").rlike(f"(?iu){path}"))
    return found.groupBy("sym", "path_kind", "kind", "path").agg(F.array_sort(F.collect_set("lno")).alias("lines"))


def merge_commas(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """Lists written with commas, of all rows of a key, as one sorted list without repeats."""
    pieces = F.filter(F.flatten(F.collect_list(F.split(column, ","))), lambda x: x != "")
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.array_distinct(pieces)), ",").alias(column))

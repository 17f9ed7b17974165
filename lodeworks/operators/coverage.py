"""Coverage: filling gaps, quantising counts, rolling up directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interpolate(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``hits`` of uncounted lines between two counted ones: 0 if both are 0, else 1; runs at the ends stay null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = F.last("hits", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first("hits", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    between = F.when(last.isNotNull() & following.isNotNull(), F.when((last == 0) & (following == 0), 0).otherwise(1))
    return lines.withColumn("filled", F.coalesce(F.col("hits"), between).cast("bigint"))


def quantise(hits: F.Column) -> F.Column:
    """Order of magnitude of a count; null without one."""
    return F.floor(F.log10(1 + hits)).cast("int")


def roll_up(nodes: DataFrame) -> DataFrame:
    """dir, covered, missed: sums of files below each directory, the root as an empty name."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(i, F.lit(1))), "/")))
    return nodes.select(F.explode(dirs).alias("dir"), "covered", "missed").groupBy("dir").agg(F.sum("covered").alias("covered"), F.sum("missed").alias("missed"))


def history(nodes: DataFrame, path: str) -> DataFrame:
    """All revisions' figures of one path, oldest first."""
    return nodes.where(F.col("path") == path).orderBy("committed")

"""Log analytics: request histograms, latencies, slowest requests, durations of build steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (0.5, 0.66, 0.75, 0.9, 0.95, 0.99)
POWERS = tuple(2**k for k in range(1, 12))
BOTS = ["bot", "crawl", "spider", "slurp"]


def micros(ts) -> F.Column:
    """Microseconds of a timestamp with or without time zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))



def without_bots(rows: DataFrame, agent: str = "agent", signs: list[str] = BOTS) -> DataFrame:
    keep = F.lit(True)
    for s in signs:
        keep &= ~F.lower(F.col(agent)).contains(s)
    return rows.where(keep)


def ip_histogram(rows: DataFrame, keys: list[str], client: str) -> DataFrame:
    """Per key: requests, clients, and for k = 2, 4, ... how many clients made k or more, and how many requests those made."""
    per = rows.groupBy(*keys, client).agg(F.count("*").alias("n"))
    heavy = [x for k in POWERS for x in (F.count_if(F.col("n") >= k).alias(f"clients_{k}"), F.coalesce(F.sum(F.when(F.col("n") >= k, F.col("n"))), F.lit(0)).alias(f"requests_{k}"))]
    return per.groupBy(*keys).agg(F.sum("n").alias("requests"), F.count("*").alias("clients"), *heavy)


def latencies(rows: DataFrame, keys: list[str], value: str, exact: bool = False) -> DataFrame:
    """Count and percentiles of a time, by a sketch of bounded size; ``exact`` keeps each distinct value of a key in one task."""
    of = (lambda p: F.percentile(value, p)) if exact else (lambda p: F.percentile_approx(value, p, 10_000))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[of(p).alias(f"p{round(p * 100)}") for p in PERCENTILES])


def slowest(rows: DataFrame, value: str, ties: list[str], n: int = 10) -> DataFrame:
    """The ``n`` slowest rows: each task keeps its own, then those meet."""
    return rows.orderBy(F.desc(value), *ties).limit(n)


def step_durations(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Each event with the seconds to the next of its key; the last has none."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return rows.withColumn("seconds", (micros(F.lead(ts).over(w)) - micros(ts)) / 1e6)


def sections(steps: DataFrame) -> DataFrame:
    """tree, label, started, ended, n_steps: steps rolled up to the section that they fall in."""
    w = Window.partitionBy("tree").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    named = steps.withColumn("section", F.last(F.when(F.col("kind") == "section", F.col("label")), True).over(w))
    return named.groupBy("tree", "section").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count_if(F.col("kind") == "step").alias("n_steps"))


def sessions(rows: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """key, session, started, ended, n: runs of events with no gap of ``gap_seconds`` or more."""
    w = Window.partitionBy(key).orderBy(ts)
    fresh = F.coalesce((micros(ts) - micros(F.lag(ts).over(w)) >= gap_seconds * 1_000_000).cast("int"), F.lit(1))
    marked = rows.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))

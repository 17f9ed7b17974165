"""Access logs and step logs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of a cache-front access log line (fixed format): time, cache, seconds, "request", status, bytes, "referrer", "agent".
_ACCESS = r'^(\S+) (\S+) ([0-9.]+) "([A-Z]+) /([^/ ?]+)/([^/ ?"]*)([^ "]*)[^"]*" ([0-9]{3}) ([0-9-]+) "([^"]*)" "([^"]*)"$'
_STEP = r"^(\S+) (section|step) (begin|end) (\S+) (.+)$"


def access_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed rows of an access log; other lines are dropped."""
    c = F.col(column)
    names = ["ts", "cache_status", "request_time", "method", "tree", "action", "rest", "status", "bytes", "referrer", "agent"]
    rows = lines.where(c.rlike(_ACCESS)).select(*[F.regexp_extract(c, _ACCESS, i).alias(n) for i, n in enumerate(names, 1)])
    return rows.withColumn("ts", F.try_to_timestamp("ts")).withColumn("request_time", F.col("request_time").cast("double")).withColumn("bytes", F.col("bytes").try_cast("bigint"))


def step_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """ts, kind (section or step), is_end, tree, label of a build's log."""
    c = F.col(column)
    part = {n: F.regexp_extract(c, _STEP, i) for i, n in enumerate(("ts", "kind", "edge", "tree", "label"), 1)}
    rows = lines.where(c.rlike(_STEP)).select(*[v.alias(n) for n, v in part.items()])
    return rows.select(F.try_to_timestamp("ts").alias("ts"), "kind", (F.col("edge") == "end").alias("is_end"), "tree", "label")

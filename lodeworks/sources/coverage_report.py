"""Coverage reports: a nested tree of directories and files as flat node and line tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "path string, is_dir boolean, percent double, covered bigint, missed bigint, total bigint, coverage array<bigint>"


def walk(node: dict, path: str = "") -> Iterator[tuple]:
    """The node's rows, parents first; a negative count means that the line cannot be covered."""
    children = node.get("children")
    lines = [None if v is None or v < 0 else v for v in node.get("coverage") or []]
    yield path, children is not None, node.get("coveragePercent"), node.get("linesCovered"), node.get("linesMissed"), node.get("linesTotal"), None if children is not None else lines
    for name, child in sorted((children or {}).items()):
        yield from walk(child, f"{path}/{name}".lstrip("/"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the reports below ``path``, one JSON document a file, walked where the file is read."""
    import json

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [r for text in pdf["value"] for r in walk(json.loads(text))]
            yield pd.DataFrame(rows, columns=["path", "is_dir", "percent", "covered", "missed", "total", "coverage"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, NODE)


def covered_lines(nodes: DataFrame) -> DataFrame:
    return nodes.where("not is_dir").select("path", F.posexplode("coverage").alias("at", "hits")).select("path", (F.col("at") + 1).alias("lno"), "hits")

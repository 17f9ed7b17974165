"""Connected components by label spreading, with every round's labels written to the shared folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, released

#: Ids that a task holds while it contracts links; it gives out what it has and begins anew beyond.
HELD_IDS = 500_000
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def find(root: dict[int, int], x: int) -> int:
    """The smallest id known to hang together with ``x``; ways there are halved."""
    while (up := root.get(x, x)) != x:
        root[x] = root.get(up, up)
        x = up
    return x


def join(root: dict[int, int], a: int, b: int) -> bool:
    """Let two ids hang together; whether they did not before."""
    x, y = find(root, a), find(root, b)
    if x != y:
        root[max(x, y)] = min(x, y)
    return x != y


def together(root: dict[int, int]) -> list[tuple[int, int]]:
    """What hangs together, as stars: (smallest, other) for every other id."""
    return [(find(root, m), m) for m in list(root)]


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the same components: each task's own as stars, so dense groups shrink to their ids."""

    def run(batches):
        root: dict[int, int] = {}

        def out():
            stars = together(root)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in stars], pa.int64()) for i in (0, 1)], schema=_LINKS)

        for batch in released(batches):
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                join(root, a, b)
            if len(root) > HELD_IDS:
                yield out()
                root.clear()
        yield out()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def _labelled(links: DataFrame) -> DataFrame:
    """rep, label of the ids of few links, all in one task."""

    def run(batches):
        root: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                join(root, a, b)
        stars = together(root)
        stars += [(a, a) for a in {a for a, _ in stars}]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in stars], pa.int64()) for i in (1, 0)], names=["rep", "label"])

    return links.select("a", "b").mapInArrow(run, "rep long, label long")


def connect(scratch: Scratch, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """rep, label: the smallest id that links reach, for every node; links are (a, b) pairs in either direction.

    In a round each node takes the least label around it, then the label of that label's node, so chains shorten
    geometrically.  Minima are taken before rows are dealt, so a hub's many links do not meet in one task.  Only linked
    nodes take part; the rest keep their own id.  Few links, counted, are joined in one task instead.
    """
    few = scratch.save(contracted(links), "few", thin=True)
    if few.count() <= HELD_IDS:
        labels = scratch.save(_labelled(few.coalesce(1)), "labels", thin=True)
        return nodes.join(F.broadcast(labels), "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"))
    both = few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.save(both, "both", thin=True)
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("rep"), F.least("a", "m").alias("label")), "labels", thin=True)
    while True:
        near = both.join(labels.select(F.col("rep").alias("b"), "label"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("label").alias("around"))
        taken = labels.join(near, "rep").select("rep", F.col("label").alias("old"), F.least("label", "around").alias("label"))
        jumped = taken.join(labels.select(F.col("rep").alias("label"), F.col("label").alias("next")), "label", "left")
        new = scratch.save(jumped.select("rep", F.least("label", F.coalesce("next", "label")).alias("label"), "old"), "labels", thin=True)
        moved = not new.where("label < old").isEmpty()
        scratch.drop(labels)
        labels = scratch.kept(new, "rep", "label")
        if not moved:
            break
    scratch.drop(both)
    return scratch.save(nodes.join(labels, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label")), "components", thin=True)

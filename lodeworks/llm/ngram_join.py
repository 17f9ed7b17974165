"""N-gram Jaccard join: every pair of texts whose word-shingle sets overlap by the threshold, as linked components.

1. Equal sets collapse to one representative, so exact copies never meet again.
2. Sets that share too few shingles with any other are done: most texts end here (``shared_grams``).
3. Shingles get one global order, the seldom ones first.  Two sets that overlap by the threshold share one of their first
   few shingles in any such order (prefix filter), so grouping by these loses no pair.
4. Each group of a shingle is cut into tiles of representatives sorted by set size.  First each member is tried against the
   smallest set of at most two of its groups; members of one component need no further trial against each other.
5. What is left, members of different components within a shingle's tile or in two tiles of one shingle, is compared by
   hashed bitmap signatures whose length follows the set's size band: a set bit that the other lacks witnesses a shingle
   that the other lacks, so bit counts bound the overlap from above.  Size bands that cannot reach the threshold are skipped.
6. What passes the bound is decided exactly, by intersecting sorted hash arrays made anew from the texts.  Sets that hang
   together by such pairs are decided together, so an array travels there once whatever the number of its pairs; the pairs
   themselves are never rows: a tile gives out only as many as tell which of its sets hang together.

Only the components are needed, so no group is ever expanded into all its pairs, and no link between texts is lost.

Defined results: null text, or text without words, has an empty set and links with nothing; a text with fewer words than a
shingle is one shingle; repeated rows of a doc_id count as copies if their texts are equal; a row without doc_id takes the
component of an equal text, else none; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import BATCH_BYTES, Scratch, merged, partitions, released, small_batches
from .components import connect, find, join, together
from .shared_grams import bitmap, prefixes, set_digest, survivors, text_sets

WIDTH = 5
#: Jaccard threshold in per cent.
PERCENT = 75
#: Representatives in a tile, at most.
TILE = 256
#: Shingles in a tile, at most, unless one text alone has more; so much is held to intersect a tile's arrays.
TILE_SHINGLES = 2_000_000
#: Sets whose pairs are decided together, at most.
UNIT_SETS = 2048
#: Tiles of a shingle that one task pairs with all others, about.
TILES_A_TASK = 16
#: Ids (8 bytes each) that are sent to all tasks rather than joined by a shuffle, at most.
BROADCAST_IDS = 1_000_000


def fold(signature: np.ndarray, size: int) -> np.ndarray:
    """A bitmap at a smaller power of two of bytes."""
    return np.bitwise_or.reduce(signature.reshape(-1, size), 0)


def overlap_bound(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """At most so many shingles are common to the sets of each row pair of equally long bitmaps."""
    only_a, only_b = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct arrays overlap by the threshold."""
    x, y = sorted((x, y), key=len)
    if not len(x):
        return False
    at = np.searchsorted(y, x)
    return bool(enough(int((y[np.minimum(at, len(y) - 1)] == x).sum()), len(x), len(y), percent))


def enough(common, n_a, n_b, percent: int):
    return 100 * common >= percent * (n_a + n_b - common)


def tile_starts(sizes: np.ndarray) -> list[int]:
    """Where tiles begin in a run of sets of these sizes: at most TILE sets and TILE_SHINGLES shingles, one set at least."""
    total, out = np.concatenate(([0], np.cumsum(sizes))), [0]
    while (end := min(out[-1] + TILE, max(out[-1] + 1, int(np.searchsorted(total, total[out[-1]] + TILE_SHINGLES, "right")) - 1))) < len(sizes):
        out.append(end)
    return out


def _tiles(prefixes: DataFrame) -> DataFrame:
    """shingle, cut, sizes, reps, low: runs of at most TILE representatives that share a shingle, sorted by set size.

    A linked pair's smaller set has some common shingle among its ``low`` first ones, so a shingle's members before its
    first ``low`` one have nothing to try there and are left out.  Rows are range-dealt by (shingle, n, rep), so even a
    shingle of very many texts is spread over tasks and each task holds one tile at a time.  ``cut``: the run may go on
    in another tile.
    """
    out = pa.schema([("shingle", pa.int64()), ("cut", pa.bool_()), ("sizes", pa.list_(pa.int64())), ("reps", pa.list_(pa.int64())), ("low", pa.list_(pa.bool_()))])
    rows = prefixes.select("n", "rep", "low", F.posexplode("prefix").alias("at", "shingle")).select("shingle", "n", "rep", (F.col("at") < F.col("low")).alias("low"))
    dealt = rows.repartitionByRange(partitions(prefixes.sparkSession), "shingle", "n", "rep").sortWithinPartitions("shingle", "n", "rep")

    def given(columns, pieces):
        """Pieces: start, end and ``cut`` of each tile."""
        found = []
        for start, end, cut in pieces:
            if not cut:
                first = np.flatnonzero(columns[3][start:end])
                start = start + int(first[0]) if len(first) else end
                if end - start < 2:
                    continue
            found.append((columns[0][start], cut, *(c[start:end] for c in columns[1:])))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(out)], schema=out)

    def run(batches):
        held, cut = None, True  # rows of a run still open; whether the next run to end may have begun elsewhere
        for batch in released(batches):
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            starts = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1]))).tolist()
            pieces = []
            for a, b in zip(starts, starts[1:]):
                cuts = [*tile_starts(columns[1][a:b]), b - a]
                pieces += [(a + s, a + e, cut or len(cuts) > 2) for s, e in zip(cuts, cuts[1:])]
                cut = False
            last = starts[-1]
            cuts = tile_starts(columns[1][last:])
            pieces += [(last + s, last + e, True) for s, e in zip(cuts, cuts[1:])]
            cut, last = cut or len(cuts) > 1, last + cuts[-1]
            if pieces:
                yield given(columns, pieces)
            held = [c[last:] for c in columns]
        if held is not None and len(held[0]):
            yield given(held, [(0, len(held[0]), True)])

    return dealt.mapInArrow(run, "shingle long, cut boolean, sizes array<long>, reps array<long>, low array<boolean>")


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on doc_id: without moving texts while the ids are few, counted; else by a shuffled join."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def _units(pairs: DataFrame, firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """(unit, a, b): pairs that hang together are decided together, as far as their arrays fit into one task.

    Ids of a larger cluster are dealt into blocks, and a unit has the pairs of two blocks, so that an array travels to as
    many units as there are blocks at most, whether its cluster is a star, a chain or dense.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    cluster = connect(scratch, ids, pairs)
    sizes = cluster.join(firsts.select("rep", "n"), "rep").groupBy("label").agg(F.greatest(F.sum("n") / TILE_SHINGLES, F.count("*") / UNIT_SETS).alias("size"))
    parts = sizes.select("label", F.when(F.col("size") <= 1, 1).otherwise(F.ceil(2 * F.col("size"))).cast("long").alias("parts"))

    def block(c):
        return F.pmod(F.xxhash64(c), "parts")

    return pairs.join(cluster.select(F.col("rep").alias("a"), "label"), "a").join(parts, "label").select(F.xxhash64("label", block("a"), block("b")).alias("unit"), "a", "b")


def _arrays(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """unit, rep, label, minor, hashes: the sorted hash array of each member (unit, rep, label, minor) for all its units."""
    of = members.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list(F.struct("unit", "label", "minor")).alias("units"))
    few = members.select("rep").distinct().count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(of) if few else of, "doc_id").select("doc_id", "text", "units")
    out = pa.schema([("unit", pa.int64()), ("rep", pa.int64()), ("label", pa.int64()), ("minor", pa.bool_()), ("hashes", pa.binary())])

    def arrays(batches):
        for batch in released(batches):
            for a, b, sets in text_sets(batch.column(1), width):
                ids, units = (batch.column(k).slice(a, b - a).to_pylist() for k in (0, 2))
                rows = [(u["unit"], i, u["label"], u["minor"], s) for i, us, s in zip(ids, units, sets, strict=True) for u in us]
                for some in by_bytes(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] if k < 4 else r[k].tobytes() for r in some], f.type) for k, f in enumerate(out)], schema=out)

    return wanted.mapInArrow(arrays, "unit long, rep long, label long, minor boolean, hashes binary")


def by_bytes(rows: list[tuple]):
    """Runs of rows whose last values, arrays, have about BATCH_BYTES together."""
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += r[-1].nbytes
        if size >= BATCH_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def unit_links(reps: list[int], labels: list[int], minor: list[bool], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join components, of the ``minor`` members of a unit with all others.

    The unit's arrays are merged into one sorted array once; a member's array is intersected with all others by looking
    its hashes up there, so that the work is the number of common hashes.
    """
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    n, label = np.array([len(x) for x in sets]), np.array(labels, np.int64)
    root: dict[int, int] = {}
    out = []
    for i in np.flatnonzero(minor).tolist():
        first = np.searchsorted(flat, sets[i], "left")
        many = np.searchsorted(flat, sets[i], "right") - first
        at = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(enough(common, n[i], n, percent) & (label != label[i])).tolist():
            if join(root, labels[i], labels[j]):
                out.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
    return out


def _settled(docs: DataFrame, edges: DataFrame, labels: DataFrame, firsts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links between different components among the sets that hang together by ``edges`` (a, b).

    Members of a cluster's largest component need no trial among themselves, so only the others, the minor ones, are tried
    against all.  A large cluster is dealt into blocks of minor and of other members; a unit has two blocks.
    """
    ids = edges.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    cluster = connect(scratch, ids, edges).withColumnRenamed("label", "cluster")
    rows = scratch.save(cluster.join(labels, "rep").join(firsts.groupBy("rep").agg(F.max("n").alias("n")), "rep"), "clusters", thin=True)
    parts = rows.groupBy("cluster", "label").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    largest = parts.groupBy("cluster").agg(F.max(F.struct("sets", "label")).alias("largest")).select("cluster", F.col("largest.label").alias("major"))
    sized = parts.join(largest, "cluster").withColumn("minor", F.col("label") != F.col("major"))
    size = F.greatest(F.sum("shingles") / TILE_SHINGLES, F.sum("sets") / UNIT_SETS)
    of_side = lambda minor: F.ceil(2 * F.greatest(*[F.sum(F.when(F.col("minor") == minor, F.col(c)).otherwise(0)) / most for c, most in (("shingles", TILE_SHINGLES), ("sets", UNIT_SETS))])).cast("int")
    blocks = sized.groupBy("cluster", "major").agg(size.alias("size"), of_side(True).alias("minors"), of_side(False).alias("majors"))
    blocks = blocks.select("cluster", "major", *[F.when(F.col("size") <= 1, 0).otherwise(F.col(c)).alias(c) for c in ("minors", "majors")])
    told = rows.join(blocks, "cluster").withColumn("minor", F.col("label") != F.col("major"))
    told = told.withColumn("block", F.when(F.col("minor"), F.pmod(F.xxhash64("rep"), F.greatest("minors", F.lit(1)))).otherwise(F.pmod(F.xxhash64("rep"), F.greatest("majors", F.lit(1)))))
    minors, majors = (F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1) for c in ("minors", "majors"))
    own = F.col("block").cast("long")  # of one type with the others: numbers of different types hash differently
    with_minor = F.transform(minors, lambda m: F.xxhash64("cluster", F.least(m, own), F.greatest(m, own), F.lit("minor")))
    with_major = F.transform(majors, lambda m: F.xxhash64("cluster", own, m, F.lit("major")))
    of_major = F.transform(minors, lambda m: F.xxhash64("cluster", m, own, F.lit("major")))
    units = F.when(F.col("minors") == 0, F.array(F.xxhash64("cluster"))).when(F.col("minor"), F.concat(with_minor, with_major)).otherwise(of_major)
    members = scratch.save(told.select(F.explode(F.array_distinct(units)).alias("unit"), "rep", "label", "minor"), "members", thin=True)
    dealt = _arrays(docs, members, width).repartition(partitions(docs.sparkSession), "unit").sortWithinPartitions("unit", "rep")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(batches):
        unit, held = None, []

        def links():
            found = unit_links(*map(list, zip(*held, strict=True)), percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], schema=out)

        for batch in released(batches):
            for k, rep, label, minor, hashes in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                if k != unit:
                    if held:
                        yield links()
                    unit, held = k, []
                held.append((rep, label, minor, np.frombuffer(hashes.as_buffer(), np.uint64).copy()))
        if held:
            yield links()

    return scratch.save(dealt.mapInArrow(settle, "a long, b long").distinct(), "links", thin=True)


def _exact(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links among the pairs (a, b), decided on the sorted hash arrays of the texts concerned.

    Within a unit only links that join what earlier ones have not are given out.
    """
    pairs = scratch.save(_units(pairs, firsts, scratch), "pairs", thin=True)
    members = scratch.save(pairs.select("unit", F.explode(F.array("a", "b")).alias("rep")).distinct(), "members", thin=True)
    none = F.lit(None)
    rows = _arrays(docs, members.withColumns({"label": none.cast("long"), "minor": none.cast("boolean")}), width).select("unit", F.lit(0).alias("kind"), "rep", none.cast("long").alias("b"), "hashes")
    rows = rows.unionByName(pairs.select("unit", F.lit(1).alias("kind"), F.col("a").alias("rep"), "b", none.cast("binary").alias("hashes")))
    dealt = rows.repartition(partitions(docs.sparkSession), "unit").sortWithinPartitions("unit", "kind", "rep", "b")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def intersect(batches):
        unit, held, root = None, {}, {}
        for batch in released(batches):
            found = []
            for k, kind, a, b, hashes in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                if k != unit:
                    unit, held, root = k, {}, {}
                if kind == 0:  # a doc_id with several texts keeps all their sets
                    held.setdefault(a, []).append(np.frombuffer(hashes.as_buffer(), np.uint64).copy())
                elif find(root, a) != find(root, b) and any(linked(s, t, percent) for s in held.get(a, ()) for t in held.get(b, ())):
                    join(root, a, b)
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], schema=out)

    links = scratch.save(dealt.mapInArrow(intersect, "a long, b long").distinct(), "links", thin=True)
    for done in (members, pairs):
        scratch.drop(done)
    return links


def _bounded(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave room for the threshold."""
    side = firsts.select("rep", "n", "bits")
    both = pairs.join(side.withColumnsRenamed({"rep": "a", "n": "n_a", "bits": "x"}), "a").join(side.withColumnsRenamed({"rep": "b", "n": "n_b", "bits": "y"}), "b")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in released(batches):
            found = []
            for a, b, n_a, n_b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                if enough(overlap_bound(fold(x, size), n_a, fold(y, size), n_b), n_a, n_b, percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], schema=out)

    return both.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a long, b long")


def bounded_pairs(left: list[dict], right: list[dict] | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of members of different components that the bitmaps let pass: within one tile, or across two.

    Members are sorted by size; the smaller of a linked pair is ``low``.
    """

    def unpacked(side):
        n, rep, label, low = (np.array([m[k] for m in side], np.int64) for k in ("n", "rep", "label", "low"))
        bits = [np.frombuffer(m["bits"], np.uint8) for m in side]
        bands = {}
        for size in {len(b) for b in bits}:
            rows = np.array([i for i, b in enumerate(bits) if len(b) == size])
            bands[size] = (rows, np.stack([bits[i] for i in rows]))
        return n, rep, label, low, bits, bands

    own = unpacked(left)
    n, rep, label, low, bits, bands = own if right is None else unpacked(right)
    found = []
    for i in range(len(left)):
        n_i, rep_i, label_i, low_i, bits_i = (own[k][i] for k in range(5))
        for size, (rows, stacked) in bands.items():
            smaller = np.where(n[rows] > n_i, low_i, np.where(n[rows] < n_i, low[rows], low_i | low[rows]))
            ok = (label[rows] != label_i) & (100 * np.minimum(n[rows], n_i) >= percent * np.maximum(n[rows], n_i)) & (smaller > 0)
            if right is None:
                ok &= rows > i
            if not ok.any():
                continue
            at, short = rows[ok], min(size, len(bits_i))
            y = stacked[ok] if short == size else np.bitwise_or.reduce(stacked[ok].reshape(len(at), -1, short), 1)
            bound = overlap_bound(fold(bits_i, short), n_i, y, n[at])
            found += [(int(min(rep_i, rep[j])), int(max(rep_i, rep[j]))) for j in at[enough(bound, n_i, n[at], percent)]]
    return found


def _between(tiles: DataFrame, firsts: DataFrame, labels: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): enough of the pairs of different components that share a shingle and pass the bitmap bound to tell which
    sets hang together by them.

    A shingle of one component has nothing left to try.  Tiles with the same members, from shingles that stand together,
    are tried once.  The tiles of a shingle that has several are dealt over more tasks the more there are.
    """
    told = F.monotonically_increasing_id()
    lone = tiles.where("not several").select("reps", "low").distinct().withColumn("tile", told).withColumn("shingle", -1 - F.col("tile"))
    numbered = scratch.save(lone.unionByName(tiles.where("several").select("reps", "low", "shingle").withColumn("tile", told)), "tiles", thin=True)
    members = numbered.select("shingle", "tile", F.explode(F.arrays_zip("reps", "low")).alias("m")).select("shingle", "tile", F.col("m.reps").alias("rep"), F.col("m.low").cast("int").alias("low")).join(labels, "rep")
    # Shingles are at hand in many tasks; only each task's least and largest label of a shingle is dealt.
    mixed = members.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count_distinct("tile").alias("tiles")).where("least < most")
    side = members.join(mixed.select("shingle", F.ceil(F.col("tiles") / TILES_A_TASK).cast("int").alias("parts")), "shingle").join(firsts.select("rep", "n", "bits"), "rep")
    full = side.groupBy("shingle", "parts", "tile").agg(F.sort_array(F.collect_list(F.struct("n", "rep", "label", "low", "bits"))).alias("members"), F.min("label").alias("least"), F.max("label").alias("most"))
    full = scratch.save(full, "full", thin=True)
    several = full.where("shingle >= 0")
    left = several.select("shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("tile").alias("t"), F.col("members").alias("l"), F.col("least").alias("least_l"), F.col("most").alias("most_l"))
    right = several.select("shingle", F.pmod(F.xxhash64("tile"), F.col("parts")).cast("int").alias("part"), F.col("tile").alias("u"), F.col("members").alias("r"), F.col("least").alias("least_r"), F.col("most").alias("most_r"))
    across = left.join(right, ["shingle", "part"]).where("t < u and (least_l <> least_r or most_l <> most_r or least_l <> most_l)").select("l", "r")
    within = full.where("least <> most").select(F.col("members").alias("l"), F.lit(None).cast(full.schema["members"].dataType).alias("r"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in released(batches):
            root: dict[int, int] = {}
            for k in range(batch.num_rows):
                for a, b in bounded_pairs(*(batch.column(i)[k].as_py() for i in (0, 1)), percent):
                    join(root, a, b)
            found = together(root)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], schema=out)

    return scratch.save(within.unionByName(across).mapInArrow(run, "a long, b long").distinct(), "rest", thin=True)


def _labelled(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, d1, d2 of every row, and n, d1, d2, label of every set that is not empty."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = scratch.save(survivors(docs, width, percent), "digest", merge=4)
    copies = scratch.save(digest.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("shares").alias("shares")), "copies", thin=True)
    sharing = scratch.save(copies.where("shares and rep is not null").select(F.col("rep").alias("doc_id")).distinct(), "sharing", thin=True)
    firsts = scratch.save(prefixes(_only(docs, sharing, "left_semi"), width, percent), "prefixes", merge=4)
    tiles = scratch.save(_tiles(firsts), "tiles", merge=4)
    low = F.filter(F.arrays_zip("sizes", "reps", "low"), lambda m: m["low"])
    cut = tiles.where("cut").groupBy("shingle").agg(F.count("*").alias("tiles"), F.min(F.get(low, F.lit(0))).alias("first"))
    cut = scratch.save(cut, "cut", thin=True)
    tiles = tiles.join(cut.select("shingle", (F.col("tiles") > 1).alias("several")), "shingle", "left").withColumn("several", F.coalesce("several", F.lit(False))).where("several or size(reps) > 1")
    member = F.explode(F.arrays_zip("reps", "sizes")).alias("m")
    stars = tiles.select(F.get(low, F.lit(0)).alias("c"), member).unionByName(tiles.where("several").join(cut, "shingle").select(F.col("first").alias("c"), member))
    reach = F.least("c.sizes", "m.sizes") * 100 >= F.greatest("c.sizes", "m.sizes") * percent
    met = stars.where(F.col("c").isNotNull() & (F.col("c.reps") != F.col("m.reps")) & reach).groupBy(F.col("m.reps").alias("m"), F.col("c.reps").alias("c")).agg(F.count("*").alias("n"))
    # Two trials a set are enough here: what they leave apart is tried against all that it shares a shingle with below.
    first_two = met.groupBy("m").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("most"), F.min("c").alias("least")).select("m", F.explode(F.array_distinct(F.array("most", "least"))).alias("c"))
    tried = first_two.select(F.least("c", "m").alias("a"), F.greatest("c", "m").alias("b")).distinct()
    near = scratch.save(_bounded(tried, firsts, percent), "near", thin=True)
    links = _exact(docs, near, firsts, width, percent, scratch)
    reps = firsts.select("rep").distinct()
    labels = connect(scratch, reps, links)
    rest = _between(tiles, firsts, labels, percent, scratch)
    if not rest.isEmpty():
        labels = connect(scratch, reps, links.unionByName(_settled(docs, rest, labels, firsts, width, percent, scratch)))
    of_set = scratch.save(copies.join(labels, "rep", "left").select("n", "d1", "d2", F.coalesce("label", "rep").alias("label")), "of-set", thin=True)
    scratch.keep(digest, of_set)
    return digest.select("doc_id", "n", "d1", "d2"), of_set


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    rows, of_set = _labelled(docs, width, percent)
    known = rows.join(of_set, ["n", "d1", "d2"], "left")
    return merged(known.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id")), 4)


def _with_digest(docs: DataFrame, width: int) -> DataFrame:
    """The rows of ``docs`` as one struct each, with their set's size and digest and the hash that decides among equal rows."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashable = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]
    told = docs.select(F.struct(*columns).alias("row"), F.xxhash64(*hashable).alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        for batch in released(batches):
            sets = [s for _, _, part in text_sets(batch.column("text"), width) for s in part]
            digests = np.array([set_digest(s) for s in sets], np.int64).reshape(-1, 2)
            made = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], digests[:, 0], digests[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)] + made, names=["row", "tie", "doc_id", "n", "d1", "d2"])

    schema = StructType([*told.schema.fields[:3], *(StructField(c, LongType()) for c in ("n", "d1", "d2"))])
    return told.mapInArrow(run, schema)


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, unchanged, but of each component only those of its smallest doc_id.

    Of rows with one doc_id, or none, and equal sets one stays.  Rows of one doc_id whose sets differ are judged each by its
    own text; a row without doc_id goes if a row with one has an equal set.  Texts without words stay.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    rows, of_set = _labelled(docs, width, percent)
    judged = rows.join(of_set, ["n", "d1", "d2"], "left").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("label") != F.col("doc_id")).alias("copy"))
    # One row for each id that has copies or is repeated; rows without an id are told apart by their text below.
    odd = scratch.save(judged.where("doc_id is not null and rows > 1").select("doc_id"), "odd", thin=True)
    gone = scratch.save(judged.where("doc_id is not null and rows = 1 and copy").select("doc_id").unionByName(odd), "gone", thin=True)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    unnamed = docs.where("doc_id is null")
    plain = _only(docs.where("doc_id is not null"), gone, "left_anti").select(*columns)
    again = not odd.isEmpty()
    if not again and rows.where("doc_id is null").isEmpty():
        return plain
    repeated = _only(docs.where("doc_id is not null"), odd, "left_semi").select(*columns) if again else docs.where("false")
    told = _with_digest(repeated.unionByName(unnamed), width).join(of_set, ["n", "d1", "d2"], "left")
    left = told.where("n = 0 or label is null or label <=> doc_id")
    once = left.where("n > 0").groupBy("doc_id", "n", "d1", "d2").agg(F.min_by("row", "tie").alias("row")).select("row.*")
    return plain.unionByName(left.where("n = 0").select("row.*")).unionByName(once)

"""Best-fit packing of token pieces into sequences of a fixed capacity, as bulk-synchronous supersteps.

Pieces are placed in bands of length, the longest first.  In a superstep the unplaced pieces of a band and the gaps are
range-sorted together by size, and one sweep from large to small finds each piece its successor, the smallest gap that
still fits and that no longer piece has taken: gaps go onto a stack, a piece takes the top.  A gap has as many places as
pieces of the band's greatest length fit into it.  Each task sweeps its own range; what it leaves over, pieces without a
gap and gaps without a piece, meets by rank across the ranges, as if one sweep had gone through all.  Gaps are then cut
down, and the superstep repeats with the pieces that are left.  When none fits any gap, as many sequences are opened as
their lengths fill at least.  Pieces longer than half the capacity open their own.

A band whose pieces and gaps fit one partition finishes its supersteps there; the sweep pairs the same sizes however its
rows are dealt.

Defined results: null or empty text is the end token alone; only documents longer than the capacity are cut, the first
piece taking the remainder; equal rows are packed as separate pieces; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, released, small_batches

CAPACITY = 1024
END_TOKEN = 2
#: Longer texts go through this package's own encoder: the fast library's pattern engine may run out of stack on them.
FAST_CHARS = 1_000_000
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Ratio of the greatest to the least length of a band of pieces.
BAND = 2
#: Pieces and gaps that one task sweeps, about.
PART_ROWS = 250_000
#: Pairs, and what a sweep leaves: ``what`` is PAIR, PIECE or GAP; ``slot`` counts a gap's places, ``rank`` what is left.
PAIR, PIECE, GAP = 0, 1, 2
_SWEPT = pa.schema([("part", pa.int64()), ("what", pa.int64()), ("key", pa.int64()), ("length", pa.int64()), ("seq", pa.int64()), ("slot", pa.int64()), ("rank", pa.int64())])
_SWEPT_DDL = "part long, what long, key long, length long, seq long, slot long, rank long"


@lru_cache(1)
def _fast(path: str):
    """An encoder of the rank file that stands beside the JSON file and holds the same vocabulary."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        specials = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit integers."""
    if len(text) > FAST_CHARS:
        from .bpe import load

        return np.array(load(path).encode(text), np.uint32)
    return _fast(path).encode_to_numpy(text, allowed_special="all")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole capacities after a first piece with the remainder."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in released(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or "", path), end_token).astype("<u4")
                rows += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PIECES)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(sizes: np.ndarray, is_gap: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """For rows sorted from large to small, gaps before pieces: each piece's gap row and place there, -1 without one, and
    the stack of gaps (row, first place free) that are left."""
    gap, slot = np.full(len(sizes), -1), np.zeros(len(sizes), np.int64)
    stack: list[list[int]] = []
    for i, opens in enumerate(is_gap.tolist()):
        if opens:
            stack.append([i, 0])
        elif stack:
            top = stack[-1]
            gap[i], slot[i] = top
            top[1] += 1
            if top[1] == places[top[0]]:
                stack.pop()
    return gap, slot, [(row, free) for row, free in stack]


def bands(capacity: int) -> list[tuple[int, int]]:
    """(least - 1, greatest) lengths of the bands below half the capacity, the longest first."""
    out, high = [], capacity // 2
    while high:
        low = min(high - 1, high // BAND)
        out.append((low, high))
        high = low
    return out


def fill(keys: np.ndarray, lengths: np.ndarray, seqs: np.ndarray, sizes: np.ndarray, high: int, capacity: int, fresh: int):
    """All supersteps of one band at once: (key, seq, offset) of the pieces, (seq, size) of the gaps afterwards.

    ``fresh`` is the id of the next new sequence; ids go down from there.
    """
    placed = []
    order = np.lexsort((keys, -lengths))
    keys, lengths = keys[order], lengths[order]
    while len(keys):
        order = np.lexsort((seqs, -sizes))
        seqs, sizes = seqs[order], sizes[order]
        both = np.lexsort((np.concatenate((np.zeros(len(sizes), np.int64), np.ones(len(lengths), np.int64))), -np.concatenate((sizes, lengths))))
        is_gap = both < len(sizes)
        places = np.maximum(1, np.concatenate((sizes, lengths))[both] // high)
        gap, slot, _ = sweep(both, is_gap, places)
        took = (gap >= 0) & ~is_gap
        if not took.any():
            n = -(-int(lengths.sum()) // capacity)
            seqs, sizes = np.concatenate((seqs, fresh - np.arange(n))), np.concatenate((sizes, np.full(n, capacity)))
            fresh -= n
            continue
        piece, into = both[took] - len(sizes), both[gap[took]]
        order = np.lexsort((slot[took], into))
        piece, into = piece[order], into[order]
        total = np.cumsum(lengths[piece]) - lengths[piece]
        first = np.concatenate(([True], into[1:] != into[:-1]))
        offset = capacity - sizes[into] + total - np.repeat(total[first], np.diff(np.append(np.flatnonzero(first), len(into))))
        placed.append((keys[piece], seqs[into], offset))
        np.subtract.at(sizes, into, lengths[piece])
        left = np.ones(len(keys), bool)
        left[piece] = False
        keys, lengths = keys[left], lengths[left]
        seqs, sizes = seqs[sizes > 0], sizes[sizes > 0]
    columns = [np.concatenate(c) for c in zip(*placed)] if placed else [np.zeros(0, np.int64)] * 3
    return columns, (seqs, sizes)


def meet(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Ranges (part, first piece, gaps' part, first place) of pieces and places that parts left over.

    ``left``: part, pieces, places, from the largest sizes on.  A part's pieces take the places of the nearest parts before
    it that still have some; places are numbered from the last one back.
    """
    stack: list[list[int]] = []
    out = []
    for part, pieces, places in left:
        at = 0
        while at < pieces and stack:
            q, used, free = stack[-1]
            n = min(pieces - at, free - used)
            out.append((part, at, q, used))
            at += n
            stack[-1][1] += n
            if stack[-1][1] == free:
                stack.pop()
        if at < pieces:
            out.append((part, at, -1, 0))
        if places:
            stack.append([part, 0, places])
    return out


def _superstep(pieces: DataFrame, gaps: DataFrame, high: int, rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pairs, pieces left): one sweep over all parts.  pairs: key, length, seq, slot."""
    spark = pieces.sparkSession
    state = gaps.select(F.lit(True).alias("gap"), F.col("size"), F.col("seq").alias("id")).unionByName(pieces.select(F.lit(False).alias("gap"), F.col("length").alias("size"), F.col("key").alias("id")))
    state = scratch.save(state.withColumn("tie", F.xxhash64("id")), "state")
    parts = max(1, min(partitions(spark), -(-rows // PART_ROWS)))
    # At most two counts a size: where rows of a size begin in the whole order; equal sizes are dealt by their tie.
    counts = {(r.size, r.gap): r.n for r in state.groupBy("size", "gap").agg(F.count("*").alias("n")).collect()}
    order = sorted(counts, key=lambda k: (-k[0], not k[1]))
    begin = dict(zip(order, np.concatenate(([0], np.cumsum([counts[k] for k in order])[:-1])).tolist(), strict=True))
    total = max(1, sum(counts.values()))

    def dealt(batches):
        for batch in batches:
            gap, size, _, tie = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            share = (tie.view(np.uint64) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            at = np.array([begin[k] + f * counts[k] for k, f in zip(zip(size.tolist(), gap.tolist(), strict=True), share.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.minimum(at * parts / total, parts - 1).astype(np.int32), pa.int32())], names=["gap", "size", "id", "tie", "part"])

    def swept(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        gap, size, ident, part = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in got]) for k in (0, 1, 2, 4))
        places = np.maximum(1, size // high)
        to, slot, stack = sweep(size, gap, places)
        piece = ~gap
        pair, lone = np.flatnonzero(piece & (to >= 0)), np.flatnonzero(piece & (to < 0))
        yield _swept_rows(part[0], PAIR, ident[pair], size[pair], ident[to[pair]], slot[pair], np.zeros(len(pair), np.int64))
        yield _swept_rows(part[0], PIECE, ident[lone], size[lone], np.zeros(len(lone), np.int64), np.zeros(len(lone), np.int64), np.arange(len(lone)))
        free = [(row, s) for row, first in reversed(stack) for s in range(first, int(places[row]))]
        row, s = (np.array([f[i] for f in free], np.int64) for i in (0, 1))
        yield _swept_rows(part[0], GAP, np.zeros(len(row), np.int64), size[row], ident[row], s, np.arange(len(row)))

    told = state.mapInArrow(dealt, "gap boolean, size long, id long, tie long, part int").repartitionById(parts, "part").sortWithinPartitions(F.desc("size"), F.desc("gap"), "tie", "id")
    result = scratch.save(told.mapInArrow(swept, _SWEPT_DDL), "swept")
    left = {}
    for r in result.where(F.col("what") != PAIR).groupBy("part", "what").agg(F.count("*").alias("n")).collect():
        left.setdefault(r.part, [0, 0])[r.what - 1] = r.n
    ranges = meet([(p, *left[p]) for p in sorted(left)])
    starts = np.array([(p << 40) + a for p, a, _, _ in ranges], np.int64)
    ranks, owners, firsts = (np.array([r[i] for r in ranges], np.int64) for i in (1, 2, 3))

    def looked_up(batches):
        for batch in batches:
            part, rank = batch.column(0).to_numpy(), batch.column(6).to_numpy()
            at = np.searchsorted(starts, (part << 40) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(owners[at]), pa.array(firsts[at] + rank - ranks[at]), batch.column(2), batch.column(3)], names=["part", "rank", "key", "length"])

    over = result.where(F.col("what") == PIECE).mapInArrow(looked_up, "part long, rank long, key long, length long") if len(ranges) else result.where("false").select("part", "rank", "key", "length")
    over = scratch.save(over, "over")
    free = result.where(F.col("what") == GAP).select("part", "rank", "seq", "slot")
    pairs = result.where(F.col("what") == PAIR).select("key", "length", "seq", "slot").unionByName(over.where("part >= 0").join(free, ["part", "rank"]).select("key", "length", "seq", "slot"))
    return pairs, over.where("part < 0").select("key", "length")


def _swept_rows(part, what, key, length, seq, slot, rank) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.full(n, part, np.int64), np.full(n, what), key, length, seq, slot, rank)], schema=_SWEPT)


def _fill_here(pieces: DataFrame, gaps: DataFrame, high: int, capacity: int, fresh: int) -> DataFrame:
    """A band in one task: placed pieces (key, seq, value: offset) and gaps afterwards (no key, seq, value: size)."""
    rows = pieces.select("key", F.col("length").alias("n"), F.lit(None).cast("long").alias("seq")).unionByName(gaps.select(F.lit(None).cast("long").alias("key"), F.col("size").alias("n"), "seq"))

    def run(batches):
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("key", pa.int64()), ("n", pa.int64()), ("seq", pa.int64())]))
        is_piece = table["key"].is_valid().to_numpy()
        n = table["n"].to_numpy()
        keys, seqs = (table[c].fill_null(0).to_numpy() for c in ("key", "seq"))
        (key, seq, offset), (gap_seq, gap_size) = fill(keys[is_piece], n[is_piece], seqs[~is_piece], n[~is_piece].copy(), high, capacity, fresh)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], names=["key", "seq", "value"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(gap_seq), pa.int64()), pa.array(gap_seq, pa.int64()), pa.array(gap_size, pa.int64())], names=["key", "seq", "value"])

    return rows.coalesce(1).mapInArrow(run, "key long, seq long, value long")


def _fill_over_parts(pieces: DataFrame, gaps: DataFrame, high: int, capacity: int, fresh: int, scratch: Scratch) -> DataFrame:
    """A band in supersteps over all parts; rows as from ``_fill_here``."""
    done = None
    pieces, gaps = scratch.save(pieces.select("key", "length"), "left"), scratch.save(gaps.select("seq", "size"), "gaps")
    while True:
        held = pieces.agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
        if not held.n:
            break
        pairs, left = _superstep(pieces, gaps, high, held.n + gaps.count(), scratch)
        w = Window.partitionBy("seq").orderBy("slot")  # a gap has at most as many places as fit
        at = pairs.withColumn("before", F.sum("length").over(w) - F.col("length")).join(gaps, "seq")
        placed = scratch.save(at.select("key", "length", "seq", (capacity - F.col("size") + F.col("before")).alias("value")), "placed")
        if placed.isEmpty():
            n = -(-held.total // capacity)
            made = pieces.sparkSession.range(n).select((fresh - F.col("id")).alias("seq"), F.lit(capacity).cast("long").alias("size"))
            fresh -= n
            gaps = scratch.save(gaps.unionByName(made), "gaps")
            continue
        used = placed.groupBy("seq").agg(F.sum("length").alias("used"))
        gaps = scratch.save(gaps.join(used, "seq", "left").select("seq", (F.col("size") - F.coalesce("used", F.lit(0))).alias("size")).where("size > 0"), "gaps")
        done = placed if done is None else done.unionByName(placed)
        pieces = scratch.save(left, "left")
    after = gaps.select(F.lit(None).cast("long").alias("key"), "seq", F.col("size").alias("value"))
    return after if done is None else done.select("key", "seq", "value").unionByName(after)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """doc_id, text -> one row per piece with its sequence and its place there."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut_up = scratch.save(pieces(docs, path, capacity, end_token).withColumn("key", F.monotonically_increasing_id()), "pieces")
    return place(cut_up, capacity, scratch).drop("key")


def place(cut_up: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """Saved pieces (key, length, ...) with sequence_id and offset.

    A piece longer than half the capacity opens the sequence of its key; the ids of sequences opened later are negative.
    """
    half = capacity // 2
    counts = {r.length: r.n for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = cut_up.where(F.col("length") > half).select("key", F.col("key").alias("seq"), F.lit(0).cast("long").alias("value"))
    gaps = cut_up.where((F.col("length") > half) & (F.col("length") < capacity)).select(F.col("key").alias("seq"), (capacity - F.col("length")).alias("size"))
    fresh, kept = -1, [cut_up]
    for low, high in bands(capacity):
        n = sum(c for length, c in counts.items() if low < length <= high)
        if not n:
            continue
        mine = cut_up.where((F.col("length") > low) & (F.col("length") <= high)).select("key", "length")
        able = gaps.where(F.col("size") > low)
        if n + able.count() <= PART_ROWS:
            result = _fill_here(mine, able, high, capacity, fresh)
        else:
            result = _fill_over_parts(mine, able, high, capacity, fresh, scratch)
        result = scratch.save(result, "band")
        gaps = scratch.save(gaps.where(F.col("size") <= low).unionByName(result.where("key is null").select("seq", F.col("value").alias("size"))), "gaps")
        kept.append(result)
        scratch.keep(*kept, gaps)
        placed = placed.unionByName(result.where("key is not null"))
        fresh = min(fresh, (result.agg(F.min("seq").alias("s")).first().s or 0) - 1)
    found = placed.select("key", F.col("seq").alias("sequence_id"), F.col("value").alias("offset"))
    return cut_up.join(found, "key")


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves.  A sequence is at most ``capacity`` ids, so a group is small.

    Needs unique doc_id values, since ids are made again and joined to their places.
    """
    places = pack(docs, path, capacity, end_token)
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for batch in released(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or "", path), end_token).astype(np.int32)
                rows += [(doc, i, ids[s : s + n].tolist()) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, ids array<int>")
    joined = made.join(places.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))

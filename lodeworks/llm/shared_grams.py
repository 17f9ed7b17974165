"""Which texts share enough shingles with others at all, and how common each shingle is.

A set that overlaps another by the threshold has that share of its shingles in common with others, so a text whose
shingles are mostly its own links with nothing and needs no further work.  ``survivors`` counts, for every row, how many
of its first shingles by hash occur in another row; ``prefixes`` counts all shingles of the rows that are left and puts
each row's shingles into one global order, the seldom ones first.

Both count through one exchange: the distinct shingles of a chunk of texts travel as sorted, delta-coded keys to the
bucket of their hash, and what the bucket has counted travels back to the chunk.  A chunk sends a shingle once whatever
the number of its texts that hold it, so a passage of very many texts costs a bucket one entry a chunk.  Keys are shorter
than hashes: two shingles that share one only look more common than they are, which never hides a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, flat_text, long_shingles, lower_ascii, mix64, partitions, released, shingle_sets

#: Share of a set, in per cent, that two linked texts have in common within their first shingles by hash.
FIRST_PERCENT = 15
#: Shingles in a bucket, about, at most; a bucket is held by one task.
BUCKET = 16_000_000
#: Bytes of text per word, about; only sizes buckets.
WORD_BYTES = 6
#: Bits of a signature; a longer set's bound is only looser.
MIN_BITS, MAX_BITS = 64, 1 << 17

_CODEC = pa.Codec("zstd", 1)
_ROWS = "bucket int, chunk long, head boolean, blobs array<binary>"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("head", pa.bool_()), ("blobs", pa.list_(pa.binary()))])


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed planes of bytes; the first five bytes tell how many and how wide."""
    values = np.asarray(values).astype(np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values).to_bytes(4, "little") + bytes([width]) + (_CODEC.compress(planes.tobytes(), asbytes=True) if len(values) else b"")


def unpack(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:4], "little"), blob[4]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(_CODEC.decompress(blob[5:], n * width, asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.zeros(1, values.dtype)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def shortfall(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` that may be missing from a linked set."""
    return n - -(-percent * n // 100)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A power of two of bits, the set's size or more up to a bound: bit ``hash mod length`` is set."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << int(len(hashes) - 1).bit_length())) if len(hashes) else MIN_BITS
    out = np.zeros(bits, bool)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def text_sets(column: pa.Array, width: int):
    """Runs of texts of one chunk's bytes: first row, end row, their sorted distinct shingle hashes."""
    data, offsets = flat_text(column)
    for a, b in chunks(offsets):
        if offsets[b] - offsets[a] > CHUNK_BYTES:  # one long text
            yield a, b, [long_shingles(data[offsets[a] : offsets[b]], width)]
            continue
        part = lower_ascii(data[offsets[a] : offsets[b]])
        yield a, b, shingle_sets(part, offsets[a : b + 1] - offsets[a], width)


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """Two sums over a set that tell equal sets, 128 bits together."""
    if not len(s):
        return 0, 0
    weighed = s * (s | np.uint64(1))
    return int((s ^ (s >> np.uint64(29))).sum(dtype=np.uint64).view(np.int64)), int((weighed ^ (weighed >> np.uint64(31))).sum(dtype=np.uint64).view(np.int64))


def _buckets(docs: DataFrame) -> tuple[int, int]:
    """Number of buckets, and bits of a key within its bucket: about one shingle of 32 meets another's key."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shingles = size // WORD_BYTES + 1
    buckets = max(partitions(docs.sparkSession), -(-shingles // BUCKET))
    return buckets, min(32, max(16, (shingles // buckets).bit_length() + 5))


def _keys(sets: list[np.ndarray], first: list[int], buckets: int, bits: int):
    """Sorted distinct keys (bucket above ``bits``), how many rows hold each, and the holding rows key by key."""
    flat = mix64(np.concatenate([s[:k] for s, k in zip(sets, first, strict=True)]) if sets else np.zeros(0, np.uint64))
    owner = np.repeat(np.arange(len(sets)), [min(len(s), k) for s, k in zip(sets, first, strict=True)])
    bucket = ((flat >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    key = (bucket << np.uint64(bits)) | (flat & np.uint64((1 << bits) - 1))
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[starts], np.diff(np.append(starts, len(key))), owner


def _sent(docs: DataFrame, width: int, buckets: int, bits: int, first, head) -> DataFrame:
    """Rows of all chunks: one head each, ``head(ids, sets, held)``, and one for each bucket with its part of the keys.

    A key that several rows of the chunk hold is sent with their number; its rows stay in the head's ``held``.
    """

    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        for batch in released(batches):
            for a, b, sets in text_sets(batch.column(1), width):
                ids = batch.column(0).slice(a, b - a)
                chunk, count = (task << 32) | count, count + 1
                keys, many, owner = _keys(sets, [first(len(s)) for s in sets], buckets, bits)
                alone = np.repeat(many == 1, many)
                again = many > 1
                held = (keys[again], many[again], owner[~alone])
                borders = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(bits)
                ends_one, ends_more = np.searchsorted(keys[~again], borders), np.searchsorted(keys[again], borders)
                out = [(chunk % buckets, True, head(ids, sets, held))]
                one, lone_owner = keys[~again], owner[alone]
                low = np.uint64((1 << bits) - 1)
                for k in np.flatnonzero((np.diff(ends_one) > 0) | (np.diff(ends_more) > 0)).tolist():
                    x, y = slice(ends_one[k], ends_one[k + 1]), slice(ends_more[k], ends_more[k + 1])
                    out.append((k, False, [pack_sorted(one[x] & low), pack(lone_owner[x]), pack_sorted(held[0][y] & low), pack(held[1][y])]))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()), *(pa.array([r[i] for r in out], t.type) for i, t in ((1, _SCHEMA.field("head")), (2, _SCHEMA.field("blobs"))))], schema=_SCHEMA)

    return docs.mapInArrow(run, _ROWS)


def _counted(sent: DataFrame, buckets: int, back) -> DataFrame:
    """Each row that reached its bucket, with what ``back`` makes of it and of the counts of its keys; heads pass."""

    def run(batches):
        by_bucket: dict[int, list] = {}
        for batch in batches:
            heads = batch.column(2)
            if heads.true_count:
                yield batch.filter(heads)
            for row in batch.filter(pc.invert(heads)).to_pylist():
                by_bucket.setdefault(row["bucket"], []).append((row["chunk"], row["blobs"]))
        for bucket in list(by_bucket):
            rows = by_bucket.pop(bucket)
            parts = [(chunk, unpack_sorted(b[0]), b[1], unpack_sorted(b[2]), unpack(b[3])) for chunk, b in rows]
            keys = np.concatenate([x for p in parts for x in (p[1], p[3])])
            many = np.concatenate([x for p in parts for x in (np.ones(len(p[1]), np.int64), p[4].astype(np.int64))])
            _, at = np.unique(keys, return_inverse=True)
            total = np.bincount(at, weights=many)[at].astype(np.int64)
            ends = np.cumsum([n for p in parts for n in (len(p[1]), len(p[3]))])
            out, a = [], 0
            for (chunk, one, owner, more, _), b, c in zip(parts, ends[::2].tolist(), ends[1::2].tolist(), strict=True):
                out.append((chunk, back(one, owner, total[a:b], more, total[b:c])))
                a = c
            for i in range(0, len(out), 64):
                some = out[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(some), pa.int32()), pa.array([c for c, _ in some], pa.int64()), pa.array([False] * len(some)), pa.array([b for _, b in some], pa.list_(pa.binary()))], schema=_SCHEMA)
        pa.default_memory_pool().release_unused()

    return sent.repartitionById(buckets, "bucket").mapInArrow(run, _ROWS)


def _gathered(counted: DataFrame, merge, schema: pa.Schema, ddl: str) -> DataFrame:
    """The columns that ``merge(head blobs, [(bucket, blobs)])`` gives for every chunk, whose rows meet again in bucket order."""
    dealt = counted.repartition(partitions(counted.sparkSession), "chunk").sortWithinPartitions("chunk", F.desc("head"), "bucket")

    def merged(rows):
        if [r["head"] for r in rows] != [True] + [False] * (len(rows) - 1):
            raise RuntimeError("a chunk came back without its head: the input changed between attempts")
        columns = merge(rows[0]["blobs"], [(r["bucket"], r["blobs"]) for r in rows[1:]])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        rows = []
        for batch in released(batches):
            for row in batch.to_pylist():
                if rows and row["chunk"] != rows[0]["chunk"]:
                    yield merged(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield merged(rows)

    return dealt.mapInArrow(run, ddl)


def _packed_ids(ids: pa.Array) -> list[bytes]:
    return [pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), pack(ids.is_valid().to_numpy(zero_copy_only=False))]


def _ids(blobs: list[bytes]) -> pa.Array:
    return pa.array(unpack(blobs[0]).view(np.int64), pa.int64(), mask=unpack(blobs[1]) == 0)


def survivors(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, d1, d2, shares: set size and digest of every row, and whether it shares enough of its first shingles.

    Two linked sets of ``n`` and ``m`` share at least the lesser of ``ahead(n)`` and ``ahead(m)`` of their first
    ``shortfall + ahead`` shingles in any one order, here that of the hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    buckets, bits = _buckets(docs)

    def ahead(n: int) -> int:
        return max(1, FIRST_PERCENT * n // 100)

    def first(n: int) -> int:
        return min(n, shortfall(n, percent) + ahead(n))

    def head(ids, sets, held):
        digests = np.array([set_digest(s) for s in sets], np.int64).reshape(-1, 2)
        return [*_packed_ids(ids), pack([len(s) for s in sets]), *(pack(digests[:, k].view(np.uint64) if len(sets) else []) for k in (0, 1)), pack(np.bincount(held[2], minlength=len(sets)))]

    def back(one, owner, total, more, total_more):
        return [pack_sorted(np.sort(unpack(owner)[total > 1]))]

    def merge(head, rows):
        n, shared = unpack(head[2]).astype(np.int64), unpack(head[5]).astype(np.int64)
        for _, (owners,) in rows:
            shared += np.bincount(unpack_sorted(owners).astype(np.int64), minlength=len(n))
        need = np.array([ahead(-(-percent * k // 100)) for k in n.tolist()], np.int64)
        return _ids(head), n, unpack(head[3]).view(np.int64), unpack(head[4]).view(np.int64), (n > 0) & (shared >= need)

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("shares", pa.bool_())])
    sent = _sent(docs, width, buckets, bits, first, head)
    return _gathered(_counted(sent, buckets, back), merge, schema, "doc_id long, n long, d1 long, d2 long, shares boolean")


def prefixes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """rep, n, bits, prefix, low of the rows whose sets share enough with others; the rest link with nothing.

    The order of shingles is by the logarithm of the number of rows that hold them, then by key.  ``prefix`` has the shared
    ones of the row's first shingles, of which a linked row must have one too; the first ``low`` of them are enough while
    the row is the smaller of the two.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    buckets, bits = _buckets(docs)

    def head(ids, sets, held):
        maps = [bitmap(s).tobytes() for s in sets]
        return [*_packed_ids(ids), pack([len(s) for s in sets]), pack_sorted(held[0]), pack(held[1]), pack(held[2]), *maps]

    def level(total):
        return np.floor(np.log2(np.maximum(total, 1))).astype(np.int64)

    def back(one, owner, total, more, total_more):
        again = total > 1
        return [pack_sorted(one[again]), pack(unpack(owner)[again]), pack(level(total[again])), pack(level(total_more))]

    def merge(head, rows):
        n, keys, many, owner, maps = unpack(head[2]).astype(np.int64), unpack_sorted(head[3]), unpack(head[4]).astype(np.int64), unpack(head[5]).astype(np.int64), head[6:]
        levels = np.concatenate([unpack(b[3]) for _, b in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        if len(levels) != len(keys):
            raise RuntimeError("counts of a chunk came back in part: the input changed between attempts")
        token = np.concatenate([np.repeat(keys, many), *((np.uint64(k) << np.uint64(bits)) | unpack_sorted(b[0]) for k, b in rows)])
        owner = np.concatenate([owner, *(unpack(b[1]).astype(np.int64) for _, b in rows)])
        level_of = np.concatenate([np.repeat(levels, many), *(unpack(b[2]).astype(np.int64) for _, b in rows)])
        order = np.lexsort((token, level_of, owner))
        token = token[order].view(np.int64)
        ends = np.cumsum(np.bincount(owner, minlength=len(n)))
        kept, lists, lows = [], [], []
        for i, (size, end) in enumerate(zip(n.tolist(), ends.tolist(), strict=True)):
            shared = end - (ends[i - 1] if i else 0)
            if not size or shared < -(-percent * size // 100):
                continue
            alone = size - shared
            kept.append(i)
            lists.append(token[end - shared : end - shared + max(0, shortfall(size, percent) + 1 - alone)].tolist())
            lows.append(max(0, size - -(-2 * percent * size // (100 + percent)) + 1 - alone))
        take = pa.array(kept, pa.int64())
        return _ids(head).take(take), n[kept], [maps[i] for i in kept], lists, lows

    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64())), ("low", pa.int64())])
    sent = _sent(docs, width, buckets, bits, lambda n: n, head)
    return _gathered(_counted(sent, buckets, back), merge, schema, "rep long, n long, bits binary, prefix array<long>, low long")


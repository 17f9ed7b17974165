"""Shared pieces of the training-data operators: shared-folder tables, Arrow text buffers and 64-bit text hashes.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``, which all executors share, so a lost
executor never loses them.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_dir

#: Rows in one Arrow batch.  Texts average a few KB, so a batch is a few MB; a very long text only makes its own batch long.
BATCH_ROWS = 512
#: Bytes in one Arrow batch, about; a single longer row is its own batch.
BATCH_BYTES = 8 << 20
#: So many partitions of a thin table go into one file, and files that a merged table has at least.
THIN = 16
FILES = 4
#: Bytes of text that the vectorised passes look at together.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker holds megabytes whatever the length of the texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Tables written once in the shared folder and read back: lineage ends there, and a lost executor costs one reread."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.saved: list[str | None] = []

    def save(self, df: DataFrame, name: str = "t", thin: bool = False, merge: int = 1) -> DataFrame:
        """``merge``: so many partitions go into one file.  ``thin``: rows are ids and numbers, a small part of a text's
        size, so that few and larger files hold them."""
        path = f"{self.base}/{name}-{len(self.saved)}"
        self.saved.append(path)
        merge = THIN if thin else merge
        (merged(df, merge) if merge > 1 else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def kept(self, df: DataFrame, *columns: str) -> DataFrame:
        """Some columns of a saved table, which can be freed like it."""
        out = df.select(*columns)
        out.scratch_path = df.scratch_path
        return out

    def drop(self, df: DataFrame) -> None:
        """Free a table that no later plan reads."""
        self._delete(df.scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Free all tables but these, once nothing else that is still to be read rests on others."""
        stay = {t.scratch_path for t in tables}
        for path in self.saved:
            if path is not None and path not in stay:
                self._delete(path)
        self.saved = [path if path in stay else None for path in self.saved]

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def merged(df: DataFrame, many: int) -> DataFrame:
    """The rows in fewer partitions; each of the old ones is still computed by itself."""
    return df.coalesce(max(FILES, partitions(df.sparkSession) // many))


def passed_through(docs: DataFrame, run) -> DataFrame:
    """``mapInArrow`` over all columns, whatever their names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, docs.schema)


def released(batches):
    """The batches, and at the end of the task the memory that the worker's allocators keep goes back to the machine."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- text buffers


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes in one array, and where each text begins (one more offset than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges [a, b) of texts of about ``size`` bytes together, one text at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


# ---------------------------------------------------------------- 64-bit hashes


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BYTE_KEY = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end begin and end."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1])) & ~edge[:-1]
    after = np.concatenate((word[1:], [False])) & ~edge[1:]
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def word_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial over the bytes of each word, taken from running sums: a fixed number of array passes for all words."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEY[data] * power[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end: a 64-bit hash of each word and the number of words of each text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    starts, ends = word_places(data, offsets)
    hashes = mix64(word_sums(data, starts, ends) + (ends - starts).astype(np.uint64) * _GOLDEN)
    return hashes, np.diff(np.searchsorted(starts, offsets))


def long_text(data: np.ndarray, size: int | None = None):
    """One long text in pieces of bytes, lower-cased, each with the hashes of the words that end in it.

    A word that a piece cuts is carried on as its sum and length, so its hash is that of the whole word.
    """
    size, mask = size or CHUNK_BYTES, (1 << 64) - 1
    held, length = 0, 0
    for a in range(0, len(data), size):
        piece = lower_ascii(data[a : a + size])
        starts, ends = word_places(piece, np.array([0, len(piece)]))
        sums, lengths = word_sums(piece, starts, ends), (ends - starts).astype(np.uint64)
        if length and len(starts) and starts[0] == 0:
            sums[0] = np.uint64((held + int(sums[0]) * pow(_BASE, length, 1 << 64)) & mask)
            lengths[0] += np.uint64(length)
        elif length:
            sums, lengths = np.concatenate((np.array([held], np.uint64), sums)), np.concatenate((np.array([length], np.uint64), lengths))
        held, length = 0, 0
        if len(ends) and ends[-1] == len(piece) and a + size < len(data):
            held, length = int(sums[-1]), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        yield piece, mix64(sums + lengths * _GOLDEN)


def _grams(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    grams = np.zeros(max(0, len(words) - len(keys) + 1), np.uint64)
    for k, key in enumerate(keys):
        grams += words[k : k + len(grams)] * key
    return mix64(grams)


def _gram_keys(width: int) -> np.ndarray:
    return mix64(np.arange(101, 101 + width, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


def _short(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The only shingle of fewer words than a shingle has."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return mix64(np.array([(words * keys[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], np.uint64))


def long_shingles(data: np.ndarray, width: int = 5, size: int | None = None) -> np.ndarray:
    """The shingle set of one long text, a piece at a time; the last words of a piece go on into the next."""
    keys, tail, parts = _gram_keys(width), np.zeros(0, np.uint64), []
    for _, words in long_text(data, size):
        words = np.concatenate((tail, words))
        if len(words) >= width:
            parts.append(np.unique(_grams(words, keys)))
        tail = words[-(width - 1) :] if width > 1 else words[:0]
    return np.unique(np.concatenate(parts)) if parts else _short(tail, keys)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``width`` words in a row; a shorter text's whole word sequence is one."""
    words, per_text = word_hashes(data, offsets)
    keys = _gram_keys(width)
    grams = _grams(words, keys)
    out, at = [], 0
    for count in per_text.tolist():
        out.append(np.unique(grams[at : at + count - width + 1]) if count >= width else _short(words[at : at + count], keys))
        at += count
    return out

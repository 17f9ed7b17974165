"""URL filters: a sorted array of 64-bit xxhash digests of rule strings, memory-mapped by every worker.

A rule is a host (with all its subdomains) and a path prefix, written ``host/path``.  A URL's possible rule strings (each
host suffix with each path prefix whose length some rule has) are hashed and looked up by vectorised binary search; a hit
counts only if the stored full string is equal, so digest collisions change nothing.  The longest rule wins.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule; without a rule the verdict is the
filter's default.  Equal rules given twice keep the first verdict; an empty rule list fits nothing.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

_MAGIC = b"LWURLF01"
WRITE_BYTES = 4 << 20
_LOWER = {c: c + 32 for c in range(65, 91)}
_OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_LOWER), slash + path


def build(rules) -> bytes:
    """The digest array: header, digests, string offsets, path lengths, verdicts, then the strings.

    ``rules``: (verdict, host, path) with verdict "allow" or "block".
    """
    first: dict[bytes, tuple[int, int]] = {}
    for verdict, host, path in rules:
        first.setdefault(f"{host.translate(_LOWER)}{path}".encode(), (int(verdict == "block"), len(path)))
    order = sorted((xxhash.xxh64_intdigest(s), s) for s in first)
    digests = np.array([d for d, _ in order], "<u8")
    offsets = np.concatenate(([0], np.cumsum([len(s) for _, s in order], dtype="<u8"))).astype("<u8")
    lengths = np.array(sorted({n for _, n in first.values()}), "<u8")
    blocked = np.array([first[s][0] for _, s in order], np.uint8)
    parts = (part.tobytes() for part in (digests, offsets, lengths, blocked))
    return b"".join([_MAGIC, struct.pack("<QQ", len(order), len(lengths)), *parts, *(s for _, s in order)])


def store(spark: SparkSession, data: bytes, path: str) -> None:
    """Bytes as a file in any store that Spark can write, a few MB at a time."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    for i in range(0, len(data), WRITE_BYTES):
        out.write(bytearray(data[i : i + WRITE_BYTES]))
    out.close()


class DigestArray:
    """A built file, mapped: pages are read as they are probed and shared by the machine's workers."""

    def __init__(self, file: str):
        self.raw = np.memmap(file, np.uint8, "r")
        if bytes(self.raw[:8]) != _MAGIC:
            raise ValueError(f"{file} is no digest array")
        n, m = struct.unpack("<QQ", bytes(self.raw[8:24]))
        at = 24

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            out, at = self.raw[at : at + size].view(kind), at + size
            return out

        self.digests, self.offsets, self.lengths, self.blocked = take(n, "<u8"), take(n + 1, "<u8"), take(m, "<u8").tolist(), take(n, "u1")
        self.heap = at

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The place of each key, or -1."""
        wanted = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        at = np.searchsorted(self.digests, wanted)
        out = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, max(0, len(self.digests) - 1))] == wanted) if len(self.digests) else []):
            p = int(at[i])
            while p < len(self.digests) and self.digests[p] == wanted[i]:  # equal digests stand together
                if bytes(self.raw[self.heap + int(self.offsets[p]) : self.heap + int(self.offsets[p + 1])]) == keys[i]:
                    out[i] = p
                    break
                p += 1
        return out


def _candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    labels = host.split(".")
    suffixes = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    return [f"{s}{path[:n]}" for n in lengths if n <= len(path) for s in suffixes]


_arrays: dict[str, DigestArray] = {}


def judge(pages: DataFrame, rules, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per page: host, path, the longest rule that fits (else null) and the verdict.

    The digest array is built once, written in the shared folder and handed to the executors as a Spark file; a worker maps
    its machine's copy.
    """
    spark = pages.sparkSession
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    file = f"{shared_dir(spark).rstrip('/')}/{name}"
    store(spark, build(rules), file)
    spark.sparkContext.addFile(file)

    def run(batches):
        if name not in _arrays:
            _arrays[name] = DigestArray(SparkFiles.get(name))
        index = _arrays[name]
        for batch in batches:
            urls = [split_url(u) for u in batch.column(1).to_pylist()]
            tried = [_candidates(h, p, index.lengths) for h, p in urls]
            flat = [c for t in tried for c in t]
            places = index.find([c.encode() for c in flat])
            best, at = [], 0
            for t in tried:
                hits = [(len(c), c, int(p)) for c, p in zip(t, places[at : at + len(t)], strict=True) if p >= 0]
                at += len(t)
                best.append(max(hits, default=None))
            verdicts = [default if b is None else ("block" if index.blocked[b[2]] else "allow") for b in best]
            columns = [[h for h, _ in urls], [p for _, p in urls], [b and b[1] for b in best], verdicts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], schema=_OUT)

    return pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")

"""Media columns: texts stored losslessly in ISO base-media containers, and the index of such containers.

``encode`` lays a payload out as fixed-size 8-bit samples of one track (ftyp, moov, mdat).  ``probe`` walks the nested
boxes of any such container and decodes the sample tables, so codec, duration and keyframe byte ranges become columns
while payload bytes are only sliced, never decoded.

Defined results: null text is empty text and gives one sample of spaces; equal texts give equal bytes (no clocks or
random ids are stored); ``probe`` of bytes that hold no track gives codec null, duration 0 and no ranges; a box whose
size field runs past its parent ends the walk of that parent; tables are read no further than their boxes.  Extra columns of the input are kept only if named.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SAMPLE_BYTES = 192
#: Samples between two keyframes.
KEY_EVERY = 16
#: Samples in one chunk of the track.
CHUNK_SAMPLES = 64
TIMESCALE = 8000
CODEC = b"raw "
_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


def pad(data: bytes) -> bytes:
    """Spaces appended up to a positive multiple of the sample size."""
    return data.ljust(max(1, -(-len(data) // SAMPLE_BYTES)) * SAMPLE_BYTES, b" ")


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def encode(payload: bytes) -> bytes:
    """A container whose only track holds ``payload`` (a positive multiple of the sample size) as 8-bit mono samples."""
    samples = len(payload) // SAMPLE_BYTES
    duration = len(payload)
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    n_chunks = -(-samples // CHUNK_SAMPLES)
    keys = range(1, samples + 1, KEY_EVERY)
    entry = _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    runs = [(1, min(samples, CHUNK_SAMPLES), 1)]
    if n_chunks > 1 and samples % CHUNK_SAMPLES:
        runs.append((n_chunks, samples % CHUNK_SAMPLES, 1))

    def moov(first: int) -> bytes:
        offsets = range(first, first + n_chunks * CHUNK_SAMPLES * SAMPLE_BYTES, CHUNK_SAMPLES * SAMPLE_BYTES)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, samples, SAMPLE_BYTES)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE_BYTES, samples)),
            _full(b"co64", struct.pack(f">I{n_chunks}Q", n_chunks, *offsets)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1)
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0")
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, duration, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    first = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(first) + _box(b"mdat", payload)


def walk(data, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, body start, body end) of each box, parents before children."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            (size,), body = struct.unpack_from(">Q", data, start + 8), start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield (*path, kind), body, start + size
        if kind in _PARENTS:
            yield from walk(data, body, start + size, (*path, kind))
        start += size


_TABLES = (b"mdhd", b"stsd", b"stts", b"stss", b"stsc", b"stsz", b"stco", b"co64")


def _entries(view, box: tuple[int, int] | None, head: int, form: str) -> list[tuple]:
    """The entries of a table whose count stands before them: no more than its box has room for."""
    if box is None or box[1] - box[0] < head:
        return []
    (count,) = struct.unpack_from(">I", view, box[0] + head - 4)
    width = struct.calcsize(form)
    return [struct.unpack_from(form, view, box[0] + head + i * width) for i in range(min(count, (box[1] - box[0] - head) // width))]


def _track(view, found: dict[bytes, tuple[int, int]]) -> dict:
    out = {"codec": None, "timescale": 0, "duration": 0, "samples": [], "keyframes": []}
    a, b = found.get(b"mdhd", (0, 0))
    if b > a and view[a] == 1 and b - a >= 32:
        out["timescale"], out["duration"] = struct.unpack_from(">IQ", view, a + 20)
    elif b > a and view[a] != 1 and b - a >= 20:
        out["timescale"], out["duration"] = struct.unpack_from(">II", view, a + 12)
    a, b = found.get(b"stsd", (0, 0))
    if b - a >= 16:
        out["codec"] = bytes(view[a + 12 : a + 16]).decode("latin-1").strip()
    a, b = found.get(b"stsz", (0, 0))
    offsets = [x for (x,) in (_entries(view, found[b"co64"], 8, ">Q") if b"co64" in found else _entries(view, found.get(b"stco"), 8, ">I"))]
    runs = _entries(view, found.get(b"stsc"), 8, ">III")
    if b - a < 12:
        return out
    fixed, n = struct.unpack_from(">II", view, a + 4)
    sizes = iter([x for (x,) in _entries(view, (a, b), 12, ">I")]) if not fixed else None
    samples, left = out["samples"], n
    for i, (first, per, _) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(offsets)
        for place in offsets[max(0, first - 1) : max(0, last)]:
            for _ in range(min(per, left)):
                size = fixed or next(sizes, None)
                if size is None or place + size > len(view):
                    break
                samples.append((place, size))
                place += size
            left = n - len(samples)
    keys = _entries(view, found.get(b"stss"), 8, ">I")
    out["keyframes"] = [samples[k - 1] for (k,) in keys if 0 < k <= len(samples)] if b"stss" in found else samples
    return out


def tracks(data: bytes) -> list[dict]:
    """Codec, timescale, duration and sample places of each track, from its own boxes alone.

    ``samples`` lists (offset, size) in order; ``keyframes`` the same for the samples that stss names (all, without stss).
    A table that claims more entries than its box holds gives those it holds; samples past the end of the data are left out.
    """
    view, found = memoryview(data), []
    for path, a, b in walk(view):
        if path[-1] == b"trak":
            found.append({})
        elif b"trak" in path and path[-1] in _TABLES:
            found[-1].setdefault(path[-1], (a, b))
    return [_track(view, boxes) for boxes in found]


def probe(data: bytes) -> dict:
    """The first track that has samples, else the first one, else nothing: codec null, duration 0, no ranges."""
    every = tracks(data)
    return next((t for t in every if t["samples"]), every[0] if every else _track(memoryview(b""), {}))


def read_payload(data: bytes, info: dict | None = None) -> bytes:
    """The stored bytes, sample by sample; samples that lie end to end are sliced together."""
    parts, start, end = [], 0, 0
    for place, size in (info or probe(data))["samples"]:
        if place != end:
            parts.append(data[start:end])
            start = place
        end = place + size
    return b"".join([*parts, data[start:end]])


_MEDIA = pa.schema([("doc_id", pa.int64()), ("media", pa.binary()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframe_ranges", pa.list_(pa.list_(pa.int64())))])


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text -> the container and its index: codec, duration in seconds, samples, [offset, size] of keyframes."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                media = encode(pad((text or "").encode()))
                info = probe(media)
                rows.append((doc, media, info["codec"], info["duration"] / info["timescale"], len(info["samples"]), [list(k) for k in info["keyframes"]]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MEDIA)], schema=_MEDIA)

    schema = "doc_id long, media binary, codec string, duration_s double, n_samples long, keyframe_ranges array<array<long>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: what a reader of the stored containers gets back, as lengths, digests and a feature line.

    The container is made, walked and read back batch by batch inside one task and never shuffled or stored whole.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                media = encode(pad(raw))
                info = probe(media)
                back = read_payload(media, info)
                keys = info["keyframes"]
                feature = f"{info['codec']};{info['duration'] / info['timescale']:.6f}s;{len(info['samples'])} samples;{len(keys)} keyframes;{keys[0][0]}-{keys[-1][0] + keys[-1][1]}"
                rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_DIGEST)], schema=_DIGEST)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)

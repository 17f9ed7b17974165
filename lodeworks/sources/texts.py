"""Documents as files and as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import placed

#: Characters of a line that results show.
SHOWN = 100
#: A line of more bytes is left out of text search.
LINE_LIMIT = 4096
#: Characters of texts that are split into words at a time; one text is never parted.
PIECE = 2_000_000


def document_path() -> Column:
    """The path that stands for a document: language, source, id."""
    return F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def files(documents: DataFrame) -> DataFrame:
    return documents.select(document_path().alias("path"), "doc_id", F.col("n_chars").alias("file_size"), "lang", "source")


def lines(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """path, lno (from 1), text of every line.  ``limit``: longer lines, in bytes, are left out."""
    out = documents.select(document_path().alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    out = out.select("path", (F.col("at") + 1).alias("lno"), "text")
    return out if limit is None else out.where(F.octet_length("text") <= limit)


def shown(text: Column) -> tuple[Column, Column]:
    """The line as results show it, trimmed and cut, and how far trimming moved it."""
    trimmed = F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")
    moved = F.char_length(text) - F.char_length(F.regexp_replace(text, r"^\s+", ""))
    return F.substring(trimmed, 1, SHOWN), moved


def _places(docs: list[tuple]):
    """A record batch of the words of documents (doc_id, path, path_kind, text), those of one path side by side."""
    import numpy as np
    import pyarrow as pa

    ids, names, kinds, texts = zip(*docs, strict=True)
    buf = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    letter = (buf | 0x20) - np.uint32(97) < 26
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    doc = np.searchsorted(begins, starts, "right") - 1
    breaks = np.flatnonzero(buf == 10)
    line = np.searchsorted(breaks, starts)
    lno = line - np.searchsorted(breaks, begins)[doc] + 1
    col = starts - np.concatenate([[0], breaks + 1])[line]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    token = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer((buf[letter] | 0x20).astype(np.uint8)))
    group = np.cumsum([False] + [a != b for a, b in zip(names, names[1:], strict=False)])[doc]
    order = np.lexsort((col, lno, group)) if len(set(names)) < len(names) else np.arange(len(starts))
    code = token.dictionary_encode()
    key = group.astype(np.int64) * (len(code.dictionary) + 1) + code.indices.to_numpy()
    first = np.zeros(len(starts), bool)
    first[order[np.unique(key[order], return_index=True)[1]]] = True
    at = pa.array(doc)
    columns = [pa.array(ids, pa.int64()).take(at), pa.array(names, pa.string()).take(at), pa.array(kinds, pa.string()).take(at), pa.array(lno, pa.int32()), pa.array(col, pa.int32()), token, pa.array(first)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "path", "path_kind", "lno", "col", "token", "first"])


def tokens(documents: DataFrame, dealt: bool = False, path_kind: Column | None = None) -> DataFrame:
    """path, doc_id, path_kind, lno, col, token for every place of every word of letters, lower-cased: documents as source
    code.  ``path_kind`` is taken of the column ``path``.

    ``dealt``: documents, not words, are dealt by path, and ``first`` tells if a word stands there for the first time in its
    path.  Without it ``first`` is of no use.  Texts pass in pieces, so a task holds no more than some of them.
    """

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > PIECE and row[1] != held[-1][1]:
                    yield _places(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield _places(held)

    named = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), document_path().alias("path"), "text")
    named = named.select("doc_id", "path", (F.lit(None).cast("string") if path_kind is None else path_kind).alias("path_kind"), "text")
    rows = named.repartition("path").sortWithinPartitions("path") if dealt else named
    return rows.mapInArrow(run, "doc_id long, path string, path_kind string, lno int, col int, token string, first boolean")

"""BPE encoding and decoding over the rules of a public tokenizer file.

A word's symbols form a doubly linked list; a priority queue holds the rank and place of each adjacent pair that a merge
rule names.  The lowest rank is merged first, its neighbours' new pairs are queued, and queue entries whose symbols have
changed since are skipped as stale.  Decoding concatenates vocabulary strings (with the file's own joiner).

Words repeat, so each task keeps the merged form of the words it has met, in a table with a bound on entries that is
cleared when full; this changes no result.

Defined results: null or empty text has no tokens; the special strings of the file are single tokens wherever they stand
in a text, as the public library has it; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words of which a worker keeps the merged form.
CACHE_WORDS = 200_000
#: A longer word is encoded but not kept.
CACHE_CHARS = 64


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte value."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one tokenizer file (JSON of the ``tokenizers`` library, BPE model, byte-level)."""

    #: The pattern that byte-level pre-tokenizers of this file format use when the file names none (fixed value).
    BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in {**self.vocab, **self.specials}.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = next((p for p in (spec["pre_tokenizer"].get("pretokenizers") or []) if p["type"] == "Split"), None)
        self.pattern = regex.compile(split["pattern"]["Regex"] if split else self.BYTE_LEVEL)
        self.joined_by = None if spec.get("decoder") else " "
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
        self.first = [self.vocab[s] for s in byte_symbols()]
        self.last = [self.vocab[s + self.suffix] for s in byte_symbols()]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.unbyte = {ord(s): b for b, s in enumerate(byte_symbols())}

    def normalize(self, text: str) -> str:
        for step in self.steps:
            if step == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif step == "Lowercase":  # character by character: no rule looks at a letter's neighbours
                text = text.lower() if text.isascii() or "Σ" not in text else "".join(map(str.lower, text))
            # Runs of white space become one space; the split pattern drops white space anyway.
        return text

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word."""
        data = word.encode()
        ids = [self.first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n, rules = len(ids), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(rule[0], i, ids[i], ids[i + 1], rule[1]) for i in range(n - 1) if (rule := rules.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if rule := rules.get((made, ids[k])):
                    heapq.heappush(queue, (rule[0], i, made, ids[k], rule[1]))
            h = before[i]
            if h >= 0 and (rule := rules.get((ids[h], made))):
                heapq.heappush(queue, (rule[0], h, ids[h], made, rule[1]))
        return tuple(x for x in ids if x >= 0)

    def word_ids(self, word: str) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            found = self.merge(word)
            if len(word) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def pieces(self, text: str):
        """The text's words, or its special tokens' ids, in order."""
        at = 0
        for m in self.special.finditer(text) if "<|" in text else ():
            yield from self.pattern.findall(self.normalize(text[at : m.start()]))
            yield self.specials[m[0]]
            at = m.end()
        yield from self.pattern.findall(self.normalize(text[at:] if at else text))

    def encode(self, text: str) -> array:
        out, cache = array("I"), self.cache
        for word in self.pieces(text):
            if isinstance(word, int):
                out.append(word)
            else:
                out.extend(cache.get(word) or self.word_ids(word))
        return out

    def decode(self, ids) -> str:
        """The ids' vocabulary strings, one after another; byte-level files with a decoder turn them back into text."""
        if self.joined_by is not None:
            return self.joined_by.join(map(self.strings.__getitem__, ids))
        return "".join(map(self.strings.__getitem__, ids)).translate(_Bytes(self.unbyte)).encode("latin-1").decode("utf-8", "replace")


class _Bytes(dict):
    """Maps a byte symbol to the character of that code; others to a question mark."""

    def __missing__(self, key):
        return "?"


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The encoder of a file, once per worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text -> doc_id, ids (array of int), decoded (string)."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(i) for i in ids], out.field(1).type), pa.array([bpe.decode(i) for i in ids], pa.string())], schema=out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text -> doc_id, n_tokens, and SHA-256 of the ids (32-bit little-endian) and of the decoded text.

    The ids and the decoded text live only inside the batch that makes them, so the output stays narrow.
    """
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = load(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(_little_endian(ids)).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], schema=out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _little_endian(ids: array) -> bytes:
    import numpy as np

    return np.frombuffer(ids, np.uint32).astype("<u4").tobytes() if len(ids) else b""

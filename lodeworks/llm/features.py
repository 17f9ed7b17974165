"""Vectorised text features for the classifiers, computed from flat byte buffers."""

from __future__ import annotations

import numpy as np

from .common import CHUNK_BYTES, chunks, long_text, lower_ascii, mix64, word_hashes

#: Texts counted together; with the bins it bounds the count matrix.
CHUNK_TEXTS = 128
WORD_BINS = 512
NGRAM_BINS = 4096


def blocks(offsets: np.ndarray):
    for a, b in chunks(offsets, CHUNK_BYTES):
        for c in range(a, b, CHUNK_TEXTS):
            yield c, min(b, c + CHUNK_TEXTS)


def _shape(shares, bins, count, again, distinct, size) -> np.ndarray:
    """A feature row per text from its counts of bytes and of words by bin, of words, repeated and distinct ones."""
    total, n_words = np.maximum(size, 1), np.maximum(count, 1)
    lines = shares[:, 10] + 1
    figures = np.stack((again / n_words, distinct / np.sqrt(n_words) / 10, distinct / n_words, np.minimum(size / n_words, 60) / 10, np.log1p(count) / 10, np.log1p(n_words / lines) / 5), 1)
    return np.concatenate((np.sqrt(shares / total[:, None]), np.sqrt(bins / n_words[:, None]), figures), 1)


def _long_quality(data: np.ndarray) -> np.ndarray:
    """The feature row of one long text, counted a piece at a time."""
    shares, bins, count, again = np.zeros(256, np.int64), np.zeros(WORD_BINS, np.int64), 0, 0
    distinct, last = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for start, (piece, words) in zip(range(0, len(data), CHUNK_BYTES), long_text(data), strict=True):
        shares += np.bincount(data[start : start + len(piece)], minlength=256)
        bins += np.bincount((words % np.uint64(WORD_BINS)).astype(np.int64), minlength=WORD_BINS)
        count += len(words)
        run = np.concatenate((last, words))
        again += int((run[1:] == run[:-1]).sum())
        distinct = np.union1d(distinct, words)
        last = run[-1:]
    return _shape(shares[None, :], bins[None, :], np.array([count]), np.array([again]), np.array([len(distinct)]), np.array([len(data)]))


def quality_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text: shares of byte values and of hashed words (square roots), then repetition and shape figures."""
    n = len(offsets) - 1
    out = np.zeros((n, 256 + WORD_BINS + 6), np.float32)
    for a, b in blocks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) > CHUNK_BYTES:
            out[a:b] = _long_quality(part)
            continue
        size, many = np.diff(at), b - a
        owner = np.repeat(np.arange(many), size)
        shares = np.bincount(owner * 256 + part, minlength=many * 256).reshape(many, 256)
        words, count = word_hashes(lower_ascii(part), at)
        of = np.repeat(np.arange(many), count)
        bins = np.bincount(of * WORD_BINS + (words % np.uint64(WORD_BINS)).astype(np.int64), minlength=many * WORD_BINS).reshape(many, WORD_BINS)
        again = np.zeros(len(words), bool)
        distinct = np.zeros(many)
        if len(words):
            again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
            order = np.lexsort((words, of))
            fresh = np.concatenate(([True], (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])))
            distinct = np.bincount(of[order][fresh], minlength=many)
        out[a:b] = _shape(shares, bins, count, np.bincount(of[again], minlength=many), distinct, size)
    return out


def ngram_counts(data: np.ndarray, offsets: np.ndarray, bins: int = NGRAM_BINS):
    """Blocks of rows of hashed counts of two and three bytes in a row, over letters only: other ASCII counts as a space."""
    letters = np.full(256, 32, np.uint8)
    letters[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
    keys = [mix64(np.arange(256, dtype=np.uint64) + np.uint64(1000 * k)) for k in range(3)]
    shift = np.uint64(64 - int(bins).bit_length() + 1)

    def counted(part: np.ndarray, at: np.ndarray, starts: int) -> np.ndarray:
        """Counts for texts laid end to end of what begins before ``starts``."""
        many = len(at) - 1
        if len(part) < 2:
            return np.zeros(many * bins, np.int64)
        owner = np.repeat(np.arange(many), np.diff(at))
        two = keys[0][part[:-1]] + keys[1][part[1:]] * np.uint64(3)
        ok = ~((part[:-1] == 32) & (part[1:] == 32)) & (owner[:-1] == owner[1:])
        ok[starts:] = False
        total = np.bincount((owner[:-1] * bins + (mix64(two) >> shift).astype(np.int64))[ok], minlength=many * bins)
        ok3 = ok[:-1] & (owner[2:] == owner[:-2])
        three = mix64(two[:-1] + keys[2][part[2:]] * np.uint64(5)) >> shift
        return total + np.bincount((owner[:-2] * bins + three.astype(np.int64))[ok3], minlength=many * bins)

    for a, b in blocks(offsets):
        text, many = data[offsets[a] : offsets[b]], b - a
        if len(text) <= CHUNK_BYTES:
            total = counted(letters[lower_ascii(text)], offsets[a : b + 1] - offsets[a], len(text))
        else:  # one long text: each piece with the two bytes that what begins in it may reach into
            pieces = (letters[lower_ascii(text[s : s + CHUNK_BYTES + 2])] for s in range(0, len(text), CHUNK_BYTES))
            total = sum(counted(p, np.array([0, len(p)]), CHUNK_BYTES) for p in pieces)
        yield a, b, total.reshape(many, bins).astype(np.float32)

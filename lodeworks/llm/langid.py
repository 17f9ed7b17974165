"""Language identification by nearest centroid over TF-IDF vectors of byte n-grams.

Training documents become normalised vectors of log counts times inverse document frequency.  Within each language,
spherical k-means makes several centroids; a text takes the language of the centroid with the largest cosine.  A text
farther from it than texts of that language and of its own length are gets rejected.

Fitted on at most ``per_language`` documents a language and ``in_all`` together (chosen by id digest), of the ``languages``
with the most documents; all documents are predicted.  Defined results: null text, or text without a letter, is ``und`` with score 0 and is rejected; without training
rows every text is ``und``; ties go to the language first in order; repeated rows are predicted alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_text, passed_through, released, small_batches
from .features import NGRAM_BINS, ngram_counts

PER_LANGUAGE = 1200
IN_ALL = 6000
#: Languages that are learned, at most: those with the most documents.
LANGUAGES = 256
CENTROIDS = 4
ROUNDS = 12
#: A text is rejected when its cosine is under this share of the training texts' ``QUANTILE`` cosine for its language.
SLACK = 0.6
QUANTILE = 0.005
#: A text with fewer n-grams has a smaller cosine by chance alone, in proportion to the root of their number.
FULL_NGRAMS = 400
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # of each centroid's language

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid, its cosine, and whether that is too far."""
        cosines = unit(np.log1p(counts) * self.idf) @ self.centroids.T
        best = cosines.argmax(1)
        cosine = np.clip(cosines[np.arange(len(best)), best], 0, 1)
        return best, cosine, cosine < self.least[best] * np.sqrt(np.minimum(1, counts.sum(1) / FULL_NGRAMS))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by spherical k-means, started from rows far from those already taken."""
    taken = [unit(x.mean(0, keepdims=True))[0]]
    near = x @ taken[0]
    for _ in range(min(k, len(x)) - 1):
        taken.append(x[int(near.argmin())])
        near = np.maximum(near, x @ taken[-1])
    c = np.array(taken)
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        c = np.array([unit(x[own == i].mean(0, keepdims=True))[0] if (own == i).any() else c[i] for i in range(len(c))])
    return c


def fit(counts: np.ndarray, langs: np.ndarray) -> Model | None:
    if not len(langs):
        return None
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = unit(np.log1p(counts) * idf)
    names, centroids, least = [], [], []
    for lang in sorted(set(langs)):
        own = x[langs == lang]
        c = clusters(own, CENTROIDS)
        names += [lang] * len(c)
        centroids.append(c)
        least += [float(np.quantile((own @ c.T).max(1), QUANTILE)) * SLACK] * len(c)
    return Model(names, np.concatenate(centroids).astype(np.float32), idf, np.array(least))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL, languages: int = LANGUAGES) -> Model | None:
    """Learn from the text and the non-null lang of ``docs``, which should hold the training documents only."""
    small_batches(docs.sparkSession)
    docs = docs.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return None
    share = min(per_language, max(1, in_all // len(sizes)))
    # The part of a language's documents whose id digest falls below its share: about ``share`` documents of each.
    position = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("p")
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, share / n))])
    chosen = docs.where(position < F.element_at(limit, F.col("lang"))).select(F.col("doc_id").cast("long"), "text", "lang")
    out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("bins", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for batch in released(batches):
            bins, counts = [], []
            for _, _, rows in ngram_counts(*flat_text(batch.column(1))):
                for row in rows:
                    full = np.flatnonzero(row)
                    bins.append(full.astype(np.uint16).tobytes())
                    counts.append(np.minimum(row[full], 65535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bins, pa.binary()), pa.array(counts, pa.binary())], schema=out)

    got = chosen.mapInArrow(run, "doc_id long, lang string, bins binary, counts binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    counts = np.zeros((got.num_rows, NGRAM_BINS), np.float32)
    for i, (b, c) in enumerate(zip(got["bins"].to_pylist(), got["counts"].to_pylist(), strict=True)):
        counts[i, np.frombuffer(b, np.uint16)] = np.frombuffer(c, np.uint16)
    return fit(counts, np.array(got["lang"].to_pylist(), object))


def _predicted(model: Model | None, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = column.to_pylist()
    known = np.array([model is not None and t is not None and _LETTER.search(t) is not None for t in texts], bool)
    lang, score, rejected = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts), bool)
    if model is not None:
        for a, b, counts in ngram_counts(*flat_text(column)):
            best, score[a:b], rejected[a:b] = model.predict(counts)
            lang[a:b] = [model.languages[i] for i in best]
    lang[~known], score[~known], rejected[~known] = UNKNOWN, 0.0, True
    return lang, score, rejected


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (cosine, 0 to 1), rejected.  Only the text is looked at."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        for batch in released(batches):
            lang, score, rejected = _predicted(sent.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], schema=out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def in_training(doc_id) -> F.Column:
    """The fixed fold: documents that the model may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is recognised; they pass through the prediction, so none is shuffled."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs.where(in_training("doc_id"))))
    at = docs.columns.index("text")

    def run(batches):
        for batch in released(batches):
            yield batch.filter(pa.array(~_predicted(sent.value, batch.column(at))[2]))

    return passed_through(docs, run)

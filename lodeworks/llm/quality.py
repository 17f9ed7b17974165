"""Quality classifier by co-training: a text view and a metadata view teach each other over rounds.

Each view is a logistic regression.  In every round both are fitted and calibrated, and look over all documents; each names
some that it is sure of, and these pseudo-labels join the other view's training set.  Calibration uses labelled rows held
back from fitting, and a last regression over the calibrated log-odds scores every document.

The classifier is fitted on a bounded sample, ``labelled`` labelled documents chosen by id digest over the whole table, and
on at most ``per_round`` pseudo-labels a view and round, chosen by digest from all documents that the view is sure of;
scoring covers all documents.  Defined results: null or blank text scores 0 and is rejected; null
metadata is a value of its own; without any labelled row of both classes every non-blank document scores 1; repeated rows
score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, flat_text, mix64, passed_through, released, small_batches
from .features import quality_features

LABELLED = 6000
ROUNDS = 3
#: Pseudo-labels that a view hands over in a round, at most, and the least confidence.
PER_ROUND = 500
CONFIDENT = 0.97
#: Of the text and the metadata view.
PENALTIES = (1e-4, 1e-2)
THRESHOLD = 0.5
META_BINS = 64


def metadata_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(lang), 2 * META_BINS + 24), np.float32)
    for i, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, xxhash.xxh64_intdigest(f"lang={a}") % META_BINS] = 1
        out[i, META_BINS + xxhash.xxh64_intdigest(f"source={b}") % META_BINS] = 1
        out[i, 2 * META_BINS + min(23, 0 if c is None or c < 0 else 1 + int(c).bit_length())] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights and bias (last) by accelerated gradient descent; deterministic."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    share = np.full(len(x), 1 / len(x), x.dtype) if weight is None else (weight / weight.sum()).astype(x.dtype)
    rate = 1 / (0.25 * float(np.einsum("ij,ij,i->", x, x, share)) + penalty)
    w = v = np.zeros(x.shape[1], x.dtype)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - rate * (x.T @ ((p - y) * share) + penalty * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    text_calibration: np.ndarray
    meta_calibration: np.ndarray
    combined: np.ndarray

    def views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of both views."""
        a, b = log_odds((text - self.mean) / self.scale, self.text), log_odds(meta, self.meta)
        return tuple(log_odds(z[:, None], c) for z, c in ((a, self.text_calibration), (b, self.meta_calibration)))

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.views(text, meta)
        return sigmoid(a), sigmoid(b), sigmoid(log_odds(np.stack((a, b), 1), self.combined))


class CoTraining:
    """Both views' training sets; every fourth labelled row is held back for calibration."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, label: np.ndarray):
        held = np.arange(len(label)) % 4 == 0
        self.sound = all(len(np.unique(label[rows])) == 2 for rows in (held, ~held))
        if self.sound:
            self.mean, self.scale = text[~held].mean(0), text[~held].std(0) + 1e-2
            self.held, self.y = (text[held], meta[held]), label[held].astype(np.float64)
            self.given = [[(text[~held], label[~held])], [(meta[~held], label[~held])]]

    def teach(self, view: int, rows: np.ndarray, label: np.ndarray) -> None:
        """Rows of the view that the other one has named."""
        self.given[view].append((rows, label))

    def fit(self) -> Model:
        """Both views fitted on what they were given, calibrated on held-back rows, and combined."""
        weights, scales = [], []
        for k, penalty in enumerate(PENALTIES):
            standard = (lambda x: ((x - self.mean) / self.scale).astype(np.float32)) if k == 0 else (lambda x: x)
            x, y = (np.concatenate(c) for c in zip(*self.given[k], strict=True))
            weights.append(fit_logistic(standard(x), y.astype(np.float32), penalty=penalty))
            # A view that knows little is calibrated to be unsure.
            scales.append(fit_logistic(log_odds(standard(self.held[k]), weights[k]).astype(np.float64)[:, None], self.y, penalty=1e-3, steps=500))
        model = Model(*weights, self.mean, self.scale, *scales, np.array([1.0, 0.0, 0.0]))
        model.combined = fit_logistic(np.stack(model.views(*self.held), 1).astype(np.float64), self.y, penalty=1e-3, steps=500)
        return model


def confident(ids: np.ndarray, known: np.ndarray, text: np.ndarray, meta: np.ndarray, salt: int):
    """(view, digest, id, label) of rows that a view is sure of and the other is not against; ``known`` rows have ids, are
    not blank and not yet used."""
    digest = mix64(ids.view(np.uint64) + np.uint64(salt)) >> np.uint64(1)
    out = []
    for view, (p, theirs) in enumerate(((text, meta), (meta, text))):
        sure = known & (np.maximum(p, 1 - p) >= CONFIDENT) & ((p >= 0.5) == (theirs >= 0.5))
        out.append((np.full(int(sure.sum()), view), digest[sure].astype(np.int64), ids[sure], (p[sure] >= 0.5).astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _featurise(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = quality_features(*flat_text(batch.column(1)))
    return text, metadata_features(*(batch.column(k).to_pylist() for k in (2, 3, 4)))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", "n_chars")


def _fetch(docs: DataFrame, wanted: DataFrame) -> pa.Table:
    """doc_id, label and both views of the rows named in ``wanted`` (doc_id, label): few, by the parameters."""
    rows = _columns(docs).join(F.broadcast(wanted), "doc_id")
    out = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("text_view", pa.binary()), ("meta_view", pa.binary())])

    def run(batches):
        for batch in released(batches):
            text, meta = _featurise(batch)
            parts = [pa.array([r.tobytes() for r in view.astype(np.float16)], pa.binary()) for view in (text, meta)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5).cast(pa.int32()), *parts], schema=out)

    return rows.select("doc_id", "text", "lang", "source", "n_chars", "label").mapInArrow(run, "doc_id long, label int, text_view binary, meta_view binary").toArrow().sort_by([("doc_id", "ascending"), ("text_view", "ascending")])


def _views(got: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(got[c].to_pylist()), np.float16).reshape(got.num_rows, -1).astype(np.float32) for c in ("text_view", "meta_view")]


def _named(docs: DataFrame, model: Model, used: list[int], per_round: int, salt: int, scratch: Scratch) -> DataFrame:
    """(view, digest, id, label): of all documents that a view is sure of, those with the smallest digests, saved."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model, np.array(sorted(used), np.int64)))
    names = ["view", "digest", "id", "label"]

    def run(batches):
        model, used = sent.value
        best = [np.zeros((4, 0), np.int64)] * 2
        for batch in released(batches):
            text, meta, _ = model.score(*_featurise(batch))
            ids = batch.column(0).fill_null(0).to_numpy()
            blank = np.array([not (t or "").strip() for t in batch.column(1).to_pylist()], bool)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & ~blank & ~np.isin(ids, used)
            found = np.stack(confident(ids, known, text, meta, salt))
            for view in (0, 1):
                both = np.concatenate((best[view], found[:, found[0] == view]), 1)
                best[view] = both[:, np.lexsort((both[2], both[1]))[:per_round]]  # a task gives out no more than may be taken
        for rows in best:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=names)

    return scratch.save(_columns(docs).mapInArrow(run, "view long, digest long, id long, label long"), "named", thin=True)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, per_round: int = PER_ROUND) -> Model | None:
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "quality")
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    got = _fetch(docs, marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    if not got.num_rows:
        return None
    state = CoTraining(*_views(got), got["label"].to_numpy().astype(np.int64))
    if not state.sound:
        return None
    used = set(got["doc_id"].to_pylist())
    for k in range(ROUNDS):
        named = _named(docs, state.fit(), list(used), per_round, k, scratch)
        taught = [named.where(F.col("view") == view).orderBy("digest", "id").limit(per_round).select("id", "label").distinct().toArrow() for view in (0, 1)]
        if not any(t.num_rows for t in taught):
            break
        for view, table in enumerate(taught):
            if table.num_rows:
                rows = _fetch(docs, spark.createDataFrame(table).groupBy(F.col("id").alias("doc_id")).agg(F.max("label").cast("int").alias("label")))
                state.teach(1 - view, _views(rows)[1 - view], rows["label"].to_numpy().astype(np.int64))
                used.update(rows["doc_id"].to_pylist())
        scratch.drop(named)
    return state.fit()


def _scores(model: Model | None, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, metadata and combined scores of a batch of (doc_id, text, lang, source, n_chars)."""
    blank = np.array([not (t or "").strip() for t in batch.column(1).to_pylist()], bool)
    parts = [np.ones(len(blank))] * 3 if model is None else model.score(*_featurise(batch))
    return tuple(np.where(blank, 0.0, p) for p in parts)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, text_score, meta_score (0 to 1) and keep."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("text_score", pa.float64()), ("meta_score", pa.float64()), ("keep", pa.bool_())])

    def run(batches):
        for batch in released(batches):
            a, b, both = _scores(sent.value, batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both), pa.array(a), pa.array(b), pa.array(both >= threshold)], schema=out)

    return _columns(docs).mapInArrow(run, "doc_id long, score double, text_score double, meta_score double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, train(docs, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, unchanged, that the classifier keeps; they pass through the scoring pass, so none is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = [docs.columns.index(c) for c in ("doc_id", "text", "lang", "source", "n_chars")]

    def run(batches):
        for batch in released(batches):
            yield batch.filter(pa.array(_scores(sent.value, batch.select(at))[2] >= threshold))

    return passed_through(docs, run)

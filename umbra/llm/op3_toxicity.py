"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, of the words' stems (four letters), of pairs of neighbours and
of pairs with one word between, in 2**24 places. Training goes through a bounded sample of labelled rows (at most
``PER_CLASS`` of each class, with ``SAMPLE_BYTES`` of text) in one task, with FTRL-proximal: every coordinate has its own rate, and the L1 term leaves most
weights at zero, so that the weights that remain are few enough to broadcast. The intercept is then moved from the
sample's share of toxic rows to that of all labelled rows.

Defined cases: a null or empty text gets the intercept's score; texts of any length are read whole; repeated rows get
equal scores; without labels every score is 0; columns of the input stay, and ``score`` replaces one of that name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import held_out, learnt, sample_of_labels, slices, table
from umbra.llm.text_hashes import Remembered, mix, stem_and_word

BITS = 24
#: Labelled rows of each class that training may use at most.
PER_CLASS = 3_000
#: The L1 term is high, so that a feature must recur in many rows to get a weight. These were chosen by cross-validation
#: over rows outside the held-out fifth.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 0.1, 6
_WORDS = Remembered(stem_and_word)
_ADD = [np.uint64(x * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for x in range(1, 5)]


def features(text: str | None) -> np.ndarray:
    """Distinct feature places of a whole text, ascending."""
    both = _WORDS.of((text or "").lower().split())
    if not len(both):
        return np.empty(0, np.int32)
    word = both >> np.uint64(32)
    stem = both & np.uint64(0xFFFFFFFF)
    grams = [mix(word + _ADD[0]), mix(stem + _ADD[1])]
    for k, gap in ((2, 1), (3, 2)):
        if len(word) > gap:
            grams.append(mix(mix(word[:-gap] + _ADD[k]) + word[gap:]))
    return np.unique((np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int32))


def train(rows: list[tuple[np.ndarray, int]], share: float | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, places, weights) after ``EPOCHS`` passes; ``share``: of label 1 among all labelled rows."""
    if not rows or len({y for _, y in rows}) < 2:
        return -30.0, np.empty(0, np.int32), np.empty(0, np.float32)
    # Only features of several rows can tell about others; they get places side by side.
    once, again = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, bool)
    for at, _ in rows:
        again[at] |= once[at]
        once[at] = True
    known = np.flatnonzero(again).astype(np.int32)
    rows = [(_found(known, at).astype(np.int32), y) for at, y in rows]
    z, n = np.zeros(len(known), np.float32), np.zeros(len(known), np.float32)
    bias_z = bias_n = 0.0
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, y = rows[k]
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= L1, 0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2)).astype(np.float32)
            bias = -bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + float(w.sum())))))
            g = p - y
            sigma = (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA
            z[at] = za + g - sigma * w
            n[at] = na + g * g
            s = (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / ALPHA
            bias_z, bias_n = bias_z + g - s * bias, bias_n + g * g
    at = np.flatnonzero(np.abs(z) > L1).astype(np.int32)
    w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
    bias = -bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA)
    seen = sum(y for _, y in rows) / len(rows)
    if share is not None and 0 < share < 1:
        bias += math.log(share / (1 - share)) - math.log(seen / (1 - seen))
    return float(bias), known[at], w.astype(np.float32)


def _found(known: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the ones of ``at`` that are known stand."""
    if not len(known):
        return np.empty(0, np.int64)
    k = np.searchsorted(known, at)
    k[k == len(known)] = 0
    return k[known[k] == at]


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> tuple[float, np.ndarray, np.ndarray]:
    """The model learnt from at most ``2 * per_class`` labelled rows outside the held-out fifth."""

    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    share = usable.agg(F.avg(F.col(label).cast("double"))).first()[0]

    def trained(rows: list[tuple[int, str]]) -> dict[str, bytes]:
        try:
            bias, at, weights = train([(features(text), y) for y, text in rows], share)
        finally:
            _WORDS.clear()
        return {"bias": np.float64(bias).tobytes(), "at": at.tobytes(), "weights": weights.tobytes()}

    made = learnt(sample_of_labels(documents, labels, label, per_class), trained) or trained([])
    return float(np.frombuffer(made["bias"], np.float64)[0]), np.frombuffer(made["at"], np.int32), np.frombuffer(made["weights"], np.float32)


class Scorer:
    """Scores of single texts."""

    def __init__(self, bias: float, at: np.ndarray, weights: np.ndarray):
        self.bias, self.at, self.weights = bias, at, weights
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[at & 0xFFFFF] = True

    def __call__(self, text: str | None) -> float:
        total = self.bias
        if len(self.at):
            at = features(text)
            at = at[self.maybe[at & 0xFFFFF]]
            k = np.searchsorted(self.at, at)
            k[k == len(self.at)] = 0
            total += float(self.weights[k[self.at[k] == at]].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def score(df: DataFrame, model: tuple[float, np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """``df`` with ``score``, the probability of label 1 for each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [x for x in df.columns if x != "score"]
    schema = df.select(kept).schema.add("score", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in _WORDS.during(slices(batches)):
            made = pa.array([scorer(x) for x in batch.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), made], [*kept, "score"])

    return df.mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

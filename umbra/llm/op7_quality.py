"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text is shared by all grades; the thresholds between grades are ordered by construction:
P(grade <= k) = sigmoid(threshold_k - x.w). The hashes are of words, of token shapes, of pairs of shapes and of
repetitions at distances one and two, weighted by the square root of their share in the text, so that the length doesn't
count. The fit uses at most ``PER_CLASS`` labelled rows of each grade, with ``SAMPLE_BYTES`` of text, in one task. The result carries the expected grade and the tail
probability P(grade >= cut) by which documents are chosen.

Defined cases: a null or empty text has only the intercept, so it gets the grade that the thresholds imply; texts of
any length are read whole; repeated rows get equal results; without labels of two grades everything is kept with tail
probability 1; columns of the input stay, but those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import held_out, learnt, sample_of_labels, slices, table
from umbra.llm.text_hashes import Remembered, mix, shape_and_word

BITS = 18
#: Labelled rows of each grade that the fit may use at most.
PER_CLASS = 3_000
#: What the words themselves weigh against their shapes, chosen by cross-validation over rows outside the held-out fifth.
WORD_WEIGHT = 0.3
EPOCHS, RATE, L2, BATCH = 12, 0.5, 1e-5, 32
_WORDS = Remembered(shape_and_word)
_LOW = np.uint64(0xFFFFFFFF)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a whole text; the values' squares sum to one for each kind of feature but the words."""
    both = _WORDS.of((text or "").split())
    if not len(both):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    word, shape = both >> np.uint64(32), both & _LOW
    kinds = [mix(shape + np.uint64(1 << 33))]
    if len(both) > 1:
        kinds.append(mix(mix(shape[:-1] + np.uint64(1 << 34)) + shape[1:]))
    for gap in (1, 2):
        if len(both) > gap:
            kinds.append(mix((word[:-gap] == word[gap:]).astype(np.uint64) + np.uint64((4 + gap) << 35)))
    kinds.append(mix(word + np.uint64(1 << 40)))
    at, values = [], []
    for k, kind in enumerate(kinds):
        place, count = np.unique((kind >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
        at.append(place)
        values.append(np.sqrt(count / len(kind)) * (WORD_WEIGHT if k == len(kinds) - 1 else 1.0))
    return np.concatenate(at), np.concatenate(values).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first as it is, each next one higher by the exponential of its parameter."""
    return np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int) -> tuple[np.ndarray, np.ndarray]:
    """(thresholds, weights) by stochastic gradient steps with a rate for each coordinate."""
    w, gw = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    raw, graw = np.zeros(grades - 1), np.full(grades - 1, 1e-6)
    share = np.cumsum(np.bincount([y for *_, y in rows], minlength=grades))[:-1] / len(rows)
    start = np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1))
    raw[0] = start[0]
    raw[1:] = np.log(np.maximum(np.diff(start), 0.1))
    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for begin in range(0, len(rows), BATCH):
            some = [rows[k] for k in order[begin : begin + BATCH]]
            at = np.concatenate([r[0] for r in some])
            x = np.concatenate([r[1] for r in some])
            row = np.repeat(np.arange(len(some)), [len(r[0]) for r in some])
            y = np.array([r[2] for r in some])
            s = np.bincount(row, x * w[at], minlength=len(some))
            edge = np.concatenate([[-np.inf], thresholds(raw), [np.inf]])
            up = np.where(y == grades - 1, 1.0, _sigmoid(edge[y + 1] - s))
            down = np.where(y == 0, 0.0, _sigmoid(edge[y] - s))
            p = np.maximum(up - down, 1e-9)
            dup, ddown = up * (1 - up), down * (1 - down)
            ds = (dup - ddown) / p / len(some)  # of -log p, by the linear score
            hit, back = np.unique(at, return_inverse=True)
            g = np.bincount(back, x * ds[row], minlength=len(hit)) + L2 * w[hit]
            gw[hit] += g * g
            w[hit] -= RATE * g / np.sqrt(gw[hit])
            de = np.zeros(grades + 1)
            np.add.at(de, y + 1, -dup / p / len(some))
            np.add.at(de, y, ddown / p / len(some))
            de = de[1:-1]
            graw_now = np.concatenate([[de.sum()], np.exp(raw[1:]) * np.cumsum(de[::-1])[::-1][1:]])
            graw += graw_now**2
            raw -= RATE * graw_now / np.sqrt(graw)
    return thresholds(raw), w


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", grades: int = 2, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray] | None:
    """The model learnt from at most ``grades * per_class`` rows outside the held-out fifth; None without two grades."""

    def trained(rows: list[tuple[int, str]]) -> dict[str, bytes]:
        if len({y for y, _ in rows}) < 2:
            return {}
        try:
            edges, w = train([(*features(text), y) for y, text in rows], grades)
        finally:
            _WORDS.clear()
        used = np.flatnonzero(w).astype(np.int32)
        return {"edges": edges.tobytes(), "at": used.tobytes(), "weights": w[used].astype(np.float32).tobytes()}

    made = learnt(sample_of_labels(documents, labels, label, per_class, grades), trained)
    if not made:
        return None
    w = np.zeros(1 << BITS, np.float32)
    w[np.frombuffer(made["at"], np.int32)] = np.frombuffer(made["weights"], np.float32)
    return np.frombuffer(made["edges"]), w


def grade(df: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, cut: int = 1, keep_from: float = 0.5, text: str = "text") -> DataFrame:
    """``df`` with ``expected_grade``, ``tail_probability`` (of grade >= ``cut``) and ``kept``."""
    names = ["expected_grade", "tail_probability"]
    rest = [x for x in df.columns if x not in (*names, "kept")]
    if model is None:
        return df.select(*rest, F.lit(float(cut)).alias(names[0]), F.lit(1.0).alias(names[1]), F.lit(True).alias("kept"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select(rest).schema.add(names[0], "double").add(names[1], "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, w = shared.value
        for batch in _WORDS.during(slices(batches)):
            s = np.empty(batch.num_rows)
            for k, value in enumerate(batch.column(text).to_pylist()):
                at, x = features(value)
                s[k] = float((w[at] * x).sum())
            above = 1 - _sigmoid(edges[None, :] - s[:, None])  # P(grade > k)
            made = [pa.array(above.sum(axis=1)), pa.array(above[:, cut - 1])]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), *made], [*rest, *names])

    return df.mapInArrow(work, schema).withColumn("kept", F.col("tail_probability") >= keep_from)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return grade(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", "kept")

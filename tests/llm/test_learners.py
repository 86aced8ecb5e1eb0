import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from umbra.llm import op3_toxicity, op7_quality
from umbra.llm.common import held_out, sample_of_labels

WORDS = [a + b for a in ("ba", "ko", "mi", "ru", "te", "lo") for b in ("ban", "dor", "fen", "lis", "mur", "tap", "wek")]
JUNK = ["%%%", "!!!", "$$$"]


def corpus(n, seed=1):
    """Rows (doc_id, text, quality, toxic): junk words have signs, toxic texts have two of three words."""
    rng, out = random.Random(seed), []
    for k in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 200))]
        toxic, quality = rng.random() < 0.2, rng.random() < 0.8
        if toxic:
            for word in rng.sample(["vilex", "nastor", "grubix"], 2):
                words.insert(rng.randrange(len(words)), word)
        if not quality:
            words = [w + rng.choice(JUNK) for w in words]
        out.append((k, " ".join(words), int(quality), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("learn")
    rows = corpus(900)
    documents = [(k, text) for k, text, *_ in rows] + [(5_000, None), (5_001, ""), (0, rows[0][1]), (None, "loose")]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, q, t) for k, _, q, t in rows[:600]] + [(None, 1, 1), (3, None, None), (99_999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {k: (q, t) for k, _, q, t in rows}


def test_toxicity_on_rows_never_learnt_from(spark, tables):
    folder, truth = tables
    rows = op3_toxicity.query(spark, folder).collect()
    assert len(rows) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    test = [(r.predicted, truth[r.doc_id][1]) for r in rows if r.doc_id in truth and (r.held_out or r.doc_id >= 600)]
    assert sum(p == t for p, t in test) / len(test) >= 0.97
    assert len({r.score for r in rows if r.doc_id == 0}) == 1


def test_l1_leaves_few_weights():
    rows = [(op3_toxicity.features(text), toxic) for _, text, _, toxic in corpus(400)]
    bias, at, weights = op3_toxicity.train(rows)
    assert 0 < len(at) < 0.05 * len(np.unique(np.concatenate([r[0] for r in rows]))) and bias < 0


def plain_ftrl(rows, share):
    """FTRL-proximal as published, one coordinate after the other."""
    op, z, n, order = op3_toxicity, {}, {}, []
    often = Counter(i for places, _ in rows for i in places)
    rows = [([i for i in places if often[i] >= 2], y) for places, y in rows]
    for epoch in range(op.EPOCHS):
        order += list(np.random.default_rng(epoch).permutation(len(rows)))

    def weight(i):
        if i == "bias":
            return -z.get(i, 0.0) / ((op.BETA + math.sqrt(n.get(i, 0.0))) / op.ALPHA)
        value = z.get(i, 0.0)
        if abs(value) <= op.L1:
            return 0.0
        return -(value - math.copysign(op.L1, value)) / ((op.BETA + math.sqrt(n.get(i, 0.0))) / op.ALPHA + op.L2)

    for k in order:
        places, y = rows[k]
        some = [*places, "bias"]
        w = {i: weight(i) for i in some}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in some:
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / op.ALPHA
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    seen = sum(y for _, y in rows) / len(rows)
    bias = weight("bias") + math.log(share / (1 - share)) - math.log(seen / (1 - seen))
    return bias, {i: weight(i) for i in z if i != "bias" and weight(i)}


def test_ftrl_against_a_plain_version():
    rng = random.Random(3)
    rows = []
    for _ in range(150):
        y = int(rng.random() < 0.4)
        rows.append((sorted({rng.randrange(40) for _ in range(6)} | {1000 + rng.randrange(400)} | ({100 + rng.randrange(3)} if rng.random() < (0.9 if y else 0.1) else set())), y))
    bias, at, weights = op3_toxicity.train([(np.array(a, np.int32), y) for a, y in rows], 0.1)
    want_bias, want = plain_ftrl(rows, 0.1)
    assert abs(bias - want_bias) < 1e-3 and set(at.tolist()) == set(want) and len(want) >= 2
    assert all(abs(w - want[i]) < 1e-3 for i, w in zip(at.tolist(), weights.tolist(), strict=True))


def test_features_against_a_plain_version():
    text = "The very (bad) Words, the bad"
    words = [re.sub(r"^\W+|\W+$", "", w) for w in text.lower().split()]
    named = {("w", w) for w in words} | {("s", w[:4]) for w in words} | {("b", *x) for x in zip(words, words[1:], strict=False)} | {("k", *x) for x in zip(words, words[2:], strict=False)}
    assert len(op3_toxicity.features(text)) == len(named) and len(op3_toxicity.features("")) == 0
    # Neither case, nor signs around words, nor white space count.
    assert (op3_toxicity.features(text) == op3_toxicity.features("the VERY bad\nwords the bad!")).all()


def likelihood(rows, edges, w):
    total = 0.0
    for at, x, y in rows:
        s = float((w[at] * x).sum())
        below = [0.0, *(1 / (1 + math.exp(-(e - s))) for e in edges), 1.0]
        total += math.log(max(below[y + 1] - below[y], 1e-12))
    return total


def test_cumulative_link_finds_the_maximum_of_the_likelihood():
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        v = rng.random()
        grade = min(2, max(0, int(3 * (v + rng.gauss(0, 0.15)))))
        rows.append((np.array([7, 9], np.int32), np.array([v, 1 - v], np.float32), grade))
    edges, w = op7_quality.train(rows, 3)
    best = likelihood(rows, edges, w)
    # No step along a coordinate or a threshold makes the observed grades much likelier; a plain search from there.
    point, at = [*edges, w[7], w[9]], lambda p: likelihood(rows, sorted(p[:2]), _vector(p))
    for _ in range(60):
        for k in range(4):
            for step in (0.3, -0.3, 0.05, -0.05):
                other = list(point)
                other[k] += step
                if at(other) > at(point):
                    point = other
    assert at(point) - best < 0.05 * abs(best) and best > 0.7 * 400 * math.log(1 / 3)


def _vector(p):
    w = np.zeros(10)
    w[7], w[9] = p[2:]
    return w


def test_sample_is_bounded_by_bytes_and_takes_one_text_an_id(spark):
    rows = [(k, "x" * 1000) for k in range(100)] + [(k, "w" * 1000) for k in range(100)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    some = sample_of_labels(documents, labels, "toxic", 40, bytes_a_class=5_500).collect()
    assert sorted(r.label for r in some) == [0] * 5 + [1] * 5 and {r.text[0] for r in some} == {"w"}
    assert len(sample_of_labels(documents, labels, "toxic", 40, bytes_a_class=10).collect()) == 2


def test_clashing_columns_and_empty_tables(spark, tables):
    folder, _ = tables
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    clash = documents.limit(5).selectExpr("*", "'a' AS score", "'b' AS tail_probability", "'c' AS label")
    scored = op3_toxicity.score(clash, op3_toxicity.fit(documents, labels))
    assert scored.columns == ["doc_id", "text", "tail_probability", "label", "score"] and scored.count() == 5
    model = op7_quality.fit(documents, labels)
    assert op7_quality.grade(clash, model).columns == ["doc_id", "text", "score", "label", "expected_grade", "tail_probability", "kept"]
    assert op7_quality.grade(clash.limit(0), model).count() == 0 and op7_quality.fit(documents.limit(0), labels) is None


def test_without_labels(spark, tables):
    folder, _ = tables
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = op3_toxicity.score(documents.limit(3), op3_toxicity.fit(documents, none))
    assert all(r.score < 1e-9 for r in scored.collect())
    model = op7_quality.fit(documents, none)
    assert model is None and all(r.kept for r in op7_quality.grade(documents.limit(3), model).collect())
    assert op3_toxicity.score(documents.limit(0), (0.0, np.array([1], np.int32), np.array([1.0], np.float32))).count() == 0


def test_quality_keeps_the_clean(spark, tables):
    folder, truth = tables
    rows = op7_quality.query(spark, folder).collect()
    assert len(rows) == 904
    assert all(r.kept == bool(truth[r.doc_id][0]) for r in rows if r.doc_id in truth)
    assert all(abs(r.expected_grade - r.tail_probability) < 1e-6 for r in rows)


def test_ordered_thresholds_of_four_grades(spark):
    rng = random.Random(2)
    rows = []
    for k in range(1500):
        grade = rng.randrange(4)
        words = [rng.choice(WORDS) + (rng.choice(JUNK) if rng.random() > grade / 3 else "") for _ in range(60)]
        rows.append((k, " ".join(words), grade))
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").selectExpr("*", "'x' AS kept")
    labels = spark.createDataFrame([(k, g) for k, _, g in rows], "doc_id long, stars int")
    edges, w = op7_quality.fit(documents, labels, "stars", grades=4)
    assert (np.diff(edges) > 0).all()
    out = op7_quality.grade(documents, (edges, w), cut=2).collect()
    truth = {k: g for k, _, g in rows}
    test = [(r.expected_grade, truth[r.doc_id]) for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(abs(round(e) - g) < 1 for e, g in test) / len(test) > 0.9
    assert all(r.kept == (r.tail_probability >= 0.5) for r in out)


def test_sample_is_bounded_and_leaves_out_the_held_out(spark, tables):
    folder, _ = tables
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    some = sample_of_labels(documents, labels, "toxic", 40)
    assert {(r.label, r["count"]) for r in some.groupBy("label").count().collect()} == {(0, 40), (1, 40)}
    assert some.where(held_out(some.doc_id)).count() == 0


def test_long_text():
    text = " ".join(random.Random(4).choice(WORDS) for _ in range(200_000))
    assert len(op3_toxicity.features(text)) and len(op7_quality.features(text)[0])

import collections
import random
import re
from fractions import Fraction

from umbra.llm import op4_near_dedup as op
from umbra.llm.graph import components


def plain(rows, words, similarity):
    sets = {}
    for i, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, base=40, copies=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for _ in range(base):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 12, 30, 80, 200]))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(copies)):
            copy = list(words)
            for _ in range(rng.randrange(1 + max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy))
    # A passage that many texts share, in parts around the threshold.
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))) for _ in range(90)]
    texts += ["", " \n", "Same words", "same WORDS"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def check(spark, rows, words, similarity):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.groups(df, words, similarity).collect()}
    assert got == plain(rows, words, similarity)


def test_three_words(spark):
    check(spark, corpus(1), 3, Fraction(85, 100))


def test_five_words_with_long_lists(spark, monkeypatch):
    monkeypatch.setattr(op, "LONG", 6)  # so that whole sets and blocks are used
    check(spark, corpus(2), 5, Fraction(8, 10))
    check(spark, corpus(3, 25, 14), 3, Fraction(85, 100))


def test_tiles_join_components_at_all_sizes():
    import numpy as np
    import pandas as pd

    sets = [np.arange(k, k + 100) for k in range(0, 30, 5)]
    frame = pd.DataFrame([{"side": s, "id": k + 10 * s, "component": k + 10 * s, "whole": x} for s in (0, 1) for k, x in enumerate(sets)])
    links = op._tile_links(Fraction(8, 10))(frame)
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = collections.defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if jac(a, b) >= 0.8:
                want[i].add(10 + j)
    assert all(b in want[a] for a, b in links.itertuples(index=False)) and len(links) >= len(sets)


def test_sketches_let_every_linked_pair_of_a_tile_pass():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    base = np.sort(rng.integers(-(1 << 62), 1 << 62, 400))
    sets = [np.unique(np.concatenate([base[rng.random(400) < keep], rng.integers(-(1 << 62), 1 << 62, extra)])) for keep, extra in ((1, 0), (0.97, 5), (0.95, 20), (0.5, 100), (0.1, 300), (0.05, 2))]
    bottom = lambda s: np.sort(s.view(np.uint64))[: op.SKETCH].view(np.int64)
    tile = pd.DataFrame([{"value": 1, "i": 0, "j": 0, "side": s, "id": k + 10 * s, "component": k + 10 * s, "n": len(x), "sketch": bottom(x)} for s in (0, 1) for k, x in enumerate(sets)])
    passed = set(op._tile_candidates(Fraction(8, 10))(tile).id)
    jac = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    linked = {x for i, a in enumerate(sets) for j, b in enumerate(sets) if jac(a, b) >= 0.8 for x in (i, 10 + j)}
    assert {0, 1, 2} <= linked <= passed


def test_odd_rows(spark):
    rows = [(1, "a b c d", "p"), (1, "a b c d", "p"), (None, "a b c d", "q"), (None, None, "r"), (7, "a b c d", "s"), (8, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = op.groups(df).collect()
    assert len(out) == 6 and sorted(r.doc_id for r in out if r.doc_id is not None and r.kept) == [1, 1, 8]
    assert {(r.text, r.kept, r.component_id) for r in out if r.doc_id is None} == {("a b c d", False, 1), (None, True, None)}
    assert {r.component_id for r in out if r.doc_id == 7} == {1}
    assert op.groups(df.limit(0)).count() == 0
    long = " ".join(f"w{k}" for k in range(60))
    unnamed = spark.createDataFrame([(None, long, 1), (None, long, 2), (None, long + " end", 3), (None, "other", 4)], "doc_id string, text string, k int")
    assert op.groups(unnamed.drop("k")).columns == ["doc_id", "text", "n_shingles", "component_id", "kept"]
    got = {r.k: r.kept for r in op.groups(unnamed).collect()}
    assert got[4] and got[1] == got[2] != got[3] and {r.component_id for r in op.groups(unnamed).collect()} == {None}


def test_hot_keys_join_as_others_do(spark, monkeypatch):
    from pyspark.sql import functions as F

    from umbra.llm import common

    monkeypatch.setattr(common, "HOT", 10)
    left = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"), "id").union(spark.range(500).selectExpr("99L", "id")).union(spark.range(30).selectExpr("CAST(NULL AS BIGINT)", "id"))
    counted = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = common.join_counted(left, counted, "k", "n", how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(counted, "k", how).collect()), key=str)


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(60) if k % 20] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for e in links if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == want and got.count() == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

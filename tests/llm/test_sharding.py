import random
import zlib
from collections import Counter, defaultdict

from umbra.llm import op9_sharding as op


def check(rows, out, shards):
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert (r.size, r.text_crc32) in {(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts[r.doc_id]}
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_even_sizes_and_whole_groups(spark):
    rng = random.Random(1)
    rows = [(k, f"text {k}") for k in range(700)]
    for g in range(30):
        rows += [(1000 + 10 * g + k, f"copy é {g}") for k in range(rng.randint(2, 8))]
    rows += [(None, None), (5000, ""), (5001, None), (0, "text 0"), (0, "text 0"), (0, "another")]
    out = op.assign(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS shard").repartition(4)).collect()
    check(rows, out, 8)
    shard = {r.doc_id: r.shard for r in out}
    groups = [{shard[i] for i, t in rows if t == f"copy é {g}"} for g in range(30)]
    assert sum(len(g) == 1 for g in groups) >= 29


def test_a_group_larger_than_a_shard(spark):
    rows = [(k, "same" if k % 3 else f"t{k}") for k in range(900)]
    out = op.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    check(rows, out, 4)


def test_links_join_exactly_the_groups(spark):
    rng = random.Random(3)
    base = [(k, rng.randrange(60)) for k in range(900)] + [(2000 + k, 99) for k in range(700)]
    edges = op.links(spark.createDataFrame(base, "node long, text_key long"), len(base), 4).collect()
    text = dict(base)
    root = {n: n for n in text}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        assert text[e.a] == text[e.b]
        root[find(e.a)] = find(e.b)
    assert len({find(n) for n in text}) == len(set(text.values()))  # a group is connected
    assert len(edges) == len(text) - len(set(text.values()))  # and its links are a tree, not all pairs
    assert max(Counter(e.b for e in edges if not e.chain).values()) <= 2 * len(base) // (4 * op.BLOCKS_A_SHARD)


def test_propagation_cuts_few_links(spark):
    base = [(10 * g + k, g) for g in range(300) for k in range(5)]
    edges = op.links(spark.createDataFrame(base, "node long, text_key long"), len(base), 8)
    pairs = [(e.a, e.b) for e in edges.collect()]
    label = lambda rounds, rows: {r.node: r.label for r in op.propagate(edges, rows, 8, rounds).collect()}
    cut = lambda at: sum(at[a] != at[b] for a, b in pairs) / len(pairs)
    # As many rows without links leave room for every group; without them the shards are full and some groups stay parted.
    assert cut(label(0, len(base))) > 0.8 and cut(label(op.ROUNDS, 2 * len(base))) < 0.01 and cut(label(op.ROUNDS, len(base))) < 0.2


def test_long_texts_and_repeated_rows(spark):
    rows = [(k, "long " * 200_000 if k < 3 else f"t{k}") for k in range(40)] + [(3, "t3")] * 5
    check(rows, op.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect(), 4)


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    check([(1, "a"), (2, "a")], op.assign(df).collect(), 8)
    assert op.assign(df.limit(0)).count() == 0


def test_main_path_has_no_python(spark, monkeypatch):
    plans, cut = [], op.cut
    monkeypatch.setattr(op, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    out = op.assign(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) > 3 and not any(x in plan for plan in plans for x in ("Python", "Arrow", "Pandas"))

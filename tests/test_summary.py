import pytest
from pyspark.sql import functions as F

from umbra.functions import geometry as G
from umbra.operators import conflict, summary
from umbra.sources import sink

NAN = float("nan")


def test_hull_and_touching(spark):
    rows = [(1, 1, 0.0, 0.0, 1.0, 1.0), (1, 2, 1.0, 1.0, 2.0, 2.0), (1, 3, NAN, 0.0, 900.0, 1.0), (1, 4, -9000.0, -9000.0, 9000.0, 0.5), (2, 5, NAN, 0.0, 1.0, 1.0), (2, 6, 5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "page int, seq int, llx double, lly double, urx double, ury double")
    got = {r.page: tuple(r)[1:] for r in summary.hull(df.where("seq <> 4"), ["page"]).collect()}
    assert got == {1: (0, 0, 2, 2), 2: (5, 5, 5, 5)} and summary.hull(df.where("seq = 5"), ["page"]).first().llx is None
    pairs = {(r.seq, r.o_seq) for r in conflict.touching(df, df, ["page"]).collect()}
    assert pairs == {(1, 1), (2, 2), (4, 4), (6, 6), (1, 2), (2, 1), (1, 4), (4, 1)}
    assert conflict.touching(df.limit(0), df, ["page"]).count() == 0


def test_glyphs_and_descriptions(spark):
    df = spark.createDataFrame([("​", 65, 1), ("�", 7, 1), ("�", 7, 2), ("a", 7, 1), ("", 1, 1)], "t string, c int, n int")
    assert [r[0] for r in df.select(summary.invisible_glyph(F.col("t"), F.col("c"), F.col("n"))).collect()] == [True, True, False, False, False]
    kinds = spark.createDataFrame([("pattern", "bic", None), ("booking", "b1", "negative"), ("booking", "b2", "positive"), ("manual", None, None), ("manual", "x", None)], "k string, r string, m string")
    assert [r[0] for r in kinds.select(summary.plain_description(F.col("k"), F.col("r"), F.col("m"))).collect()] == ["found by the pattern bic", "must stay, by the list entry b1", "on the list, entry b2", "marked by hand", "marked by hand: x"]
    assert spark.createDataFrame([([],), ([255, 0],)], "p array<int>").select(summary.non_white_ratio(F.col("p")).alias("x")).collect() == [(0.0,), (0.5,)]
    assert G.covered_at_least is not None


def test_covering_agrees_with_the_fraction(spark):
    import itertools

    sides = [(0.0, 0.0), (0.0, 10.0), (5.0, 5.0), (2.0, 8.0), (0.0, 1e308), (-3.0, 4.0), (9.0, 12.0)]
    rows = [(a, c, b, d, e, g, f, h) for (a, b), (c, d), (e, f), (g, h) in itertools.product(sides, repeat=4)]
    df = spark.createDataFrame(rows, ", ".join(f"{p}{n} double" for p in ("", "o_") for n in ("llx", "lly", "urx", "ury")))
    for share in (0.5, 0.999):
        wrong = df.where(G.covered_at_least(G.rect(), G.rect("o_"), share) != (G.covered_fraction(G.rect(), G.rect("o_")) >= share))
        assert wrong.count() == 0


def test_targets_and_whole_files(spark, tmp_path):
    a, b = str(tmp_path / "a.pdf"), str(tmp_path / "b.pdf")
    for x in (a, b):
        sink.write_whole(x, b"in")
    plan = sink.plan_outputs([a, b])
    assert plan == {a: a.replace(".pdf", "_redacted.pdf"), b: b.replace(".pdf", "_redacted.pdf")}
    for bad in (lambda: sink.check_target(a, [a]), lambda: sink.check_target(a, []), lambda: sink.check_target(str(tmp_path), []), lambda: sink.check_target(f"{tmp_path}/no/x.pdf", []), lambda: sink.plan_outputs([a, b], output="x"), lambda: sink.write_whole(a, b"new")):
        with pytest.raises(ValueError):
            bad()
    assert sink.check_target(a, [b], force=True) == a
    rows = [(plan[a], bytearray(b"one")), (plan[b], bytearray(b"two")), (a, bytearray(b"other")), (f"{tmp_path}/no/x.pdf", bytearray(b"x"))]
    files = spark.createDataFrame(rows, "path string, content binary")
    for _ in range(2):  # the second time as after a lost executor
        got = {r.path: (r.bytes, r.error is None) for r in sink.write_files(files).collect()}
        assert got == {plan[a]: (3, True), plan[b]: (3, True), a: (None, False), f"{tmp_path}/no/x.pdf": (None, False)}
    assert open(plan[a], "rb").read() == b"one" and open(a, "rb").read() == b"in" and not list(tmp_path.glob("*.part"))
    assert sink.write_files(files.where(files.path == a), force=True).first().bytes == 5

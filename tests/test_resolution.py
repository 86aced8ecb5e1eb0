import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from umbra.functions import geometry as G
from umbra.functions import text as T
from umbra.operators import booking, conflict, effects, leaks, lines, mask, patterns
from umbra.plans import redaction
from umbra.sources import lists
from umbra.sources.runs import page_boxes, placed, text_runs

SCHEMA = "doc_id long, page long, seq long, kind string, ref string, match_type string, confidence double, text string, llx double, lly double, urx double, ury double"


def usable(r):
    return all(math.isfinite(v) for v in r)


def area(r):
    return max(r[2] - r[0], 0) * max(r[3] - r[1], 0) if usable(r) else 0.0


def covered(a, b):
    if area(a) <= 2.3e-16:
        x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
        return float(usable(b) and usable(a) and b[0] <= x <= b[2] and b[1] <= y <= b[3])
    if not usable(a) or not usable(b):
        return 0.0
    part = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0) / area(a)
    return part if math.isfinite(part) else 0.0


def plain(regions):
    """Block by the first negative region that covers half; keep what no kept region of the same source holds."""
    kept, blocked = [], []
    negatives = [r for r in regions if r[3] == "booking" and r[5] == "negative"]
    for r in (r for r in regions if r not in negatives):
        hit = next((n for n in negatives if n[:2] == r[:2] and covered(r[8:], n[8:]) >= 0.5), None) if r[3] != "manual" else None
        (blocked if hit else kept).append((r, hit))
    out = []
    for r, _ in sorted(kept, key=lambda x: (x[0][:2], x[0][8], x[0][2])):
        if not any(k[:2] == r[:2] and k[3:7] == r[3:7] and covered(r[8:], k[8:]) >= 0.999 for k in out):
            out.append(r)
    return {(r[0], r[2]) for r in out}, {(r[0], r[2]): n[4] for r, n in blocked}


def layout(doc, mode, rng):
    out = []
    for k in range(rng.randint(5, 40)):
        if mode == "column":
            r = [50, 10 * rng.randrange(30), 150, 0]
            r[3] = r[1] + rng.choice([10, 10, 20])
        elif mode == "row":
            r = [rng.randrange(300), 10, 0, 20]
            r[2] = r[0] + rng.choice([20, 40])
        elif mode == "nested":
            d = rng.randrange(20)
            r = [d, d, 100 - d, 100 - d]
        elif mode == "flat":
            r = [rng.randrange(20), rng.randrange(20), 0, 0]
            r[2], r[3] = r[0] + rng.choice([0, 10]), r[1]
        elif mode == "huge":
            r = [-rng.randrange(10_000), -5, rng.randrange(10_000), 5 + rng.randrange(3)]
        else:
            r = [rng.uniform(-50, 200) for _ in range(2)]
            r += [r[0] + rng.uniform(0, 120), r[1] + rng.uniform(0, 120)]
        kind, ref, match = rng.choice([("pattern", "a", None), ("pattern", "b", None), ("booking", "n", "negative"), ("booking", "p", "positive"), ("manual", "m", None)])
        if mode == "nan" and rng.random() < 0.3:
            r[rng.randrange(4)] = rng.choice([math.nan, math.inf, -math.inf])
        out.append((doc, rng.randrange(2), k, kind, f"{ref}{k}" if match == "negative" else ref, match, 0.9 if kind == "pattern" else None, f"t{k}", *map(float, r)))
    return out


def test_random_layouts_against_a_plain_version(spark):
    rng = random.Random(4)
    docs = [layout(d, mode, rng) for d, mode in enumerate(["column", "row", "nested", "flat", "huge", "mixed", "cluster"] * 5)]
    kept, blocked = conflict.resolve(spark.createDataFrame([r for d in docs for r in d], SCHEMA))
    want = [plain(d) for d in docs]
    assert {(r.doc_id, r.seq) for r in kept.collect()} == set().union(*(w[0] for w in want))
    assert {(r.doc_id, r.seq): r.booking_id for r in blocked.collect()} == {k: v for w in want for k, v in w[1].items()}


def test_unusable_rectangles_block_nothing(spark):
    rng = random.Random(5)
    docs = [layout(d, "nan", rng) for d in range(8)]
    kept, blocked = conflict.resolve(spark.createDataFrame([r for d in docs for r in d], SCHEMA))
    want = {k: v for d in docs for k, v in plain(d)[1].items()}
    assert {(r.doc_id, r.seq): r.booking_id for r in blocked.collect()} == want


def test_budget_and_order(spark):
    rows = [(1, 0, k, "manual", "m", None, None, None, 0.0, 0.0, 1.0, 1.0) for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert conflict.within_budget(df, 5).count() == 5
    with pytest.raises(Exception, match="too many regions"):
        conflict.within_budget(df, 4).collect()


def texts_of(spark, *texts):
    return placed(spark.createDataFrame(list(enumerate(texts)), "run_seq int, text string").withColumn("doc_id", F.lit(1).cast("long")))


def found(spark, entries, *texts):
    rows = booking.find(texts_of(spark, *texts), entries).orderBy("run_seq", "entry_seq", "start").collect()
    return [(r.run_seq, r.booking_id, r.start, r.text) for r in rows], rows


@pytest.mark.parametrize("short", [True, False])
def test_booking(spark, monkeypatch, short):
    if not short:
        monkeypatch.setattr(booking, "SHORT_LIST", 0)  # through the automaton
    e = booking.Entry
    order = [e("p1", "positive", "alpha"), e("n1", "negative", "beta"), e("p2", "positive", "gamma"), e("n2", "negative", "delta")]
    hits, rows = found(spark, order, "gamma alpha delta beta", "beta alpha")
    assert [f"{a}:{b}" for a, b, *_ in hits] == ["0:n1", "0:n2", "0:p1", "0:p2", "1:n1", "1:p1"]
    negative = next(r for r in rows if r.booking_id == "n1")
    assert (negative.llx, negative.lly, negative.urx, negative.ury) == (5.0 * 18 - 2, 778.0, 5.0 * 22 + 2, 792.0)
    assert found(spark, [e("x", "positive", "abc")], "abc xx ABC")[0] == [(0, "x", 0, "abc"), (0, "x", 7, "ABC")]
    assert [h[2] for h in found(spark, [e("x", "positive", "ana")], "anananx")[0]] == [0]
    assert len(found(spark, [e("x", "positive", "Max Mustermann", None, "Kontoinhaber")], "Max Mustermann ist KONTOINHABER", "Max Mustermann ist")[0]) == 1
    assert [h[2] for h in found(spark, [e("x", "positive", "no", "b", None)], "no b no no")[0]] == [5, 8]
    assert found(spark, [e("x", "positive", "Jürgen  Müller ")], "Herr Jürgen \t  MÜLLER!")[0] == [(0, "x", 5, "Jürgen \t  MÜLLER")]
    assert found(spark, [e("x", "positive", "Max Fischer")], "an Max ﬁscher")[0] == [(0, "x", 3, "Max ﬁscher")]
    assert found(spark, [e("x", "positive", "a.b*c\\E")], "xa.b*c\\Ey", "aXbbc")[0] == [(0, "x", 1, "a.b*c\\E")]
    assert found(spark, [e("x", "positive", "3704 0044")], "DE89 3704", "0044 0532")[0] == []


def test_booking_errors(spark):
    for bad in (booking.Entry("a", "positive", "Rg\\d+", None, None, True), booking.Entry("a", "positive", "  "), booking.Entry("a", "other", "x")):
        with pytest.raises(ValueError):
            booking.compiled([bad])
    data = b"\xef\xbb\xbfID, List_Type ,pattern,is_regex,more\na,positive,x,nein,1\n,,\nb,NEGATIVE, y ,\n"
    assert [(e.id, e.list_type, e.pattern) for e in lists.booking_list(data)] == [("a", "positive", "x"), ("b", "negative", "y")]
    for bad in (b"id,pattern\n", b"id,list_type,pattern\na,positive,\n", b"id,list_type,pattern\na,positive,x\na,positive,y\n", b"id,list_type,pattern,is_regex\na,positive,x,perhaps\n"):
        with pytest.raises(ValueError):
            lists.booking_list(bad)


def glyph_hits(rect, text, lly, pad=1.0):
    x0, y0, x1, y1 = rect[0] - pad, rect[1] - pad, rect[2] + pad, rect[3] + pad
    hits = []
    for i in range(len(text)):
        cover = max(min(x1, 5 * i + 5) - max(x0, 5 * i), 0) * max(min(y1, lly + 10) - max(y0, lly), 0) / 50
        if x1 > x0 and y1 > y0 and (cover >= 0.25 or (x0 <= 5 * i + 2.5 <= x1 and y0 <= lly + 5 <= y1)):
            hits.append(i)
    return hits


def test_hidden_characters_against_single_glyphs(spark):
    rng = random.Random(6)
    text = "abcdefghijklmnopqrst"
    rects = [(x, y, x + rng.uniform(0, 40), y + rng.uniform(0, 14)) for x, y in ((rng.uniform(-10, 110), rng.uniform(760, 795)) for _ in range(300))]
    regions = spark.createDataFrame([(1, 0, k, "manual", "m", None, None, None, *r) for k, r in enumerate(rects)], SCHEMA)
    got = {r.seq: (r.lo, r.hi) for r in mask.hidden_spans(texts_of(spark, text), regions).collect()}
    for k, r in enumerate(rects):
        hits = glyph_hits(r, text, 780.0)
        assert got.get(k) == ((hits[0], hits[-1]) if hits else None), (k, r)


@pytest.mark.parametrize("action, want", [("blackout", "ab███fgh██"), ("whiteout", "ab   fgh  "), ("replace", "ab[X]fgh[X]")])
def test_mask(spark, action, want):
    spans = spark.createDataFrame([(1, 0, 0, 0, 2, 3), (1, 0, 0, 1, 3, 4), (1, 0, 0, 2, 8, 9)], "doc_id long, page long, run_seq long, seq long, lo long, hi long")
    row = mask.mask(texts_of(spark, "abcdefghij"), spans, action, "[X]").first()
    assert (row.masked, row.removed) == (want, 5)


def test_whole_run_leaves_no_leak(spark):
    texts = spark.createDataFrame([(1, "mail a@b.de now\nand a@b.de twice a@b.de"), (2, "nothing"), (3, "BIC: COBADEFFXXX keep@me.org")], "doc_id long, text string")
    config = redaction.RunConfig(entries=[booking.Entry("keep", "negative", "keep@me.org")], action="replace")
    out = redaction.run(texts, config)
    masked = {(r.doc_id, r.run_seq): r.masked for r in out.masked.collect()}
    assert masked[1, 1] == "and [GESCHWÄRZT] twice [GESCHWÄRZT]" and masked[2, 0] == "nothing" and masked[3, 0] == "BIC: [GESCHWÄRZT] keep@me.org"
    assert {r.verdict for r in out.check().collect()} == {"gone"}
    assert [r.booking_id for r in out.blocked.collect()] == ["keep"]
    totals = {r.doc_id: (r.requested, r.applied, r.removed_glyphs) for r in out.measured().collect()}
    assert totals == {1: (3, 3, 18), 3: (1, 1, 11)}
    log = effects.audit_log(effects.audit_entries(out.effects), out.blocked, out.measured(), texts).where("doc_id = 3").first()
    assert '"booking_id":"keep"' in log.log and "COBADEFFXXX" not in log.log


def test_review_round_trip(spark):
    texts = spark.createDataFrame([(1, "a@b.de"), (2, "c@d.de")], "doc_id long, text string")
    runs = text_runs(texts)
    regions = conflict.collect(None, None, patterns.find(runs))
    files = effects.review_files(regions, texts, page_boxes(runs))
    edited = files.withColumn("review", F.when(F.col("doc_id") == 2, F.replace("review", F.lit('"enabled":true'), F.lit('"enabled":false'))).otherwise(F.col("review")))
    items = effects.read_reviews(edited)
    assert [(r.doc_id, r.text) for r in items.collect()] == [(1, "a@b.de")]
    assert {r.identity for r in effects.identity(items, texts).collect()} == {"match"}
    assert {r.identity for r in effects.identity(items, texts.withColumn("text", F.lit("x"))).collect()} == {"mismatch"}
    with pytest.raises(Exception, match="unknown review version"):
        effects.read_reviews(files.withColumn("review", F.replace("review", F.lit('"version":1'), F.lit('"version":2')))).collect()


@pytest.mark.parametrize("few", [True, False])
def test_leaks(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(leaks, "FEW", 0)
    carriers = spark.createDataFrame([(1, 7, "the secret word"), (2, 7, "these cretword"), (3, 7, "DE89 37\n04"), (4, 1, None)], "carrier_id long, view int, content string")
    rows = leaks.search_text(carriers, ["secret word", "secret", "DE89 3704"]).collect()
    assert {(r.carrier_id, r.needle_id, r.literal) for r in rows} == {(1, 0, True), (1, 1, True), (2, 0, False), (3, 2, False)}
    places = leaks.occurrences(spark.createDataFrame([(1, 7, "abxab\tab")], "carrier_id long, view int, content string"), ["ab"], 2).collect()
    assert [(r.at, r.context) for r in places] == [(0, "abxab.ab"), (3, "abxab.ab")]
    with pytest.raises(ValueError):
        leaks.checked_needles(["a", " "])
    parts = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd"), (2, 0, "x")], "carrier_id long, part int, content string")
    assert [(r.carrier_id, r.content) for r in leaks.joined_contents(parts).collect()] == [(1, "abcd")]


def test_kept_texts_are_no_leaks(spark):
    redacted = spark.createDataFrame([(1, "A B"), (1, " A B "), (1, "X Y"), (1, "gone")], "doc_id long, text string")
    kept = spark.createDataFrame([(1, "A B"), (1, "XY")], "doc_id long, text string")
    masked = spark.createDataFrame([(1, 0, "A B and X"), (1, 1, "Y")], "doc_id long, run_seq long, masked string")
    out = {r.needle: r.verdict for r in leaks.export_check(masked, leaks.export_needles(redacted, kept)).collect()}
    assert out == {"A B": "kept", "X Y": "kept", "gone": "gone"}


def test_nan_matrix(spark):
    values = [0.0, 10.0, math.nan, math.inf]
    rows = [(*a, 0.0, 0.0, 5.0, 5.0) for a in itertools.product(values, repeat=4)]
    names = [*G.Rect._fields, *(f"o_{x}" for x in G.Rect._fields)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    a, b = G.rect(), G.rect("o_")
    for r in df.select("*", G.covered_fraction(a, b).alias("c"), G.intersects(a, b).alias("i"), G.empty(a).alias("e"), G.area(a).alias("area")).collect():
        q = tuple(r)[:4]
        assert r.c == covered(q, (0, 0, 5, 5)) and r.area == area(q)
        assert r.e == (not usable(q) or q[2] <= q[0] or q[3] <= q[1])


def test_text_functions(spark):
    one = spark.createDataFrame([("ﬁ  JüRG\tΟΔΟΣ", "a‮b\u0007", "Müller €")], "a string, b string, c string")
    row = one.select(T.normalize(F.col("a")).alias("n"), T.safe_text(F.col("b")).alias("s"), T.to_winansi(F.col("c")).alias("w"), T.from_winansi(T.to_winansi(F.col("c"))).alias("back"), T.pdf_string(F.unhex(F.lit("FEFF00E4"))).alias("p")).first()
    assert (row.n, row.s, bytes(row.w), row.back, row.p) == ("fi jürg οδοσ", "a\\u{202e}b\\u{7}", "Müller €".encode("cp1252"), "Müller €", "ä")


def test_lines_pitch_and_layers(spark):
    def glyphs(text, step, y, dx=1.0, dy=0.0):
        return [(1, 0, c, (k * step) * dx + (0 if dx else 100.0), (k * step) * dy + (y if dx else 0.0), 5.0, dx, dy, 5.0) for k, c in enumerate(text) if c != " "]

    rows = glyphs("plain words here", 5.0, 700.0) + glyphs("wide spaced line", 8.0, 680.0) + glyphs("upward", 5.0, 0.0, 0.0, 1.0) + [(1, 0, "²", 200.0, 701.0, 5.0, 1.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, page long, ch string, x double, y double, advance double, dx double, dy double, space double")
    out = {(r.direction, r.text) for r in lines.lines(df).collect()}
    assert (90, "upward") in out and (0, "wide spaced line") in out and any(t.startswith("²plain") or t.startswith("plain words here") for _, t in out)
    layered = lines.layers(spark.createDataFrame([(1, 0, k, float(b), float(e)) for k, (b, e) in enumerate([(0, 10), (5, 8), (10, 12), (9, 20)])], "doc_id long, page long, print_run long, begin double, end double"))
    assert {(r.print_run, r.layer) for r in layered.collect()} == {(0, 0), (1, 1), (3, 1), (2, 0)}
    stats = lines.font_statistics(spark.createDataFrame([(1, "f", k, "�" if k < 2 else "a", False) for k in range(50)] + [(1, "g", k, "x", True) for k in range(3)] + [(1, "h", 1, "y", True)], "doc_id long, font string, code int, ch string, mapped boolean"))
    assert {(r.font, r.warns, r.uniform) for r in stats.collect()} == {("f", True, False), ("g", True, True), ("h", False, False)}


def test_small_inputs(spark, tmp_path):
    region = b'[{"page": 1, "rect": {"ll": {"x": 9, "y": 8}, "ur": {"x": 1, "y": 2}}, "text": null, "source": {"manual": {"reason": "r"}}}]'
    row = lists.manual_regions(spark, region).first()
    assert (row.page, row.llx, row.lly, row.urx, row.ury, row.reason) == (1, 1.0, 2.0, 9.0, 8.0, "r")
    with pytest.raises(ValueError):
        lists.manual_regions(spark, region.replace(b'"page": 1', b'"page": -1'))
    assert lists.settings("padding: 2.5 # points\naction: 'replace'\npatterns: [a, b]\n") == {"padding": 2.5, "action": "replace", "patterns": ["a", "b"]}
    for bad in ("unknown: 1", "min_confidence: 3", "padding: .inf\npadding: 1", "  a: 1\n b: 2"):
        with pytest.raises(ValueError):
            lists.settings(bad)
    assert lists.output_name("a/b.pdf") == "a/b_redacted.pdf"
    with pytest.raises(ValueError):
        lists.output_name("a.pdf", "/x")
    (tmp_path / "n.txt").write_bytes(b"one\n\n two \n")
    assert lists.needle_list(lists.read_bounded(spark, str(tmp_path / "n.txt")).decode()) == ["one", "two"]
    with pytest.raises(ValueError):
        lists.read_bounded(spark, str(tmp_path / "n.txt"), 3)


def test_stream(spark, tmp_path):
    from umbra.streaming.detect import detect_stream, redact_stream

    spark.createDataFrame([(1, "write to a@b.de"), (2, "no hit")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    assert detect_stream(stream).isStreaming
    redact_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert {r.masked for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"write to ██████", "no hit"}

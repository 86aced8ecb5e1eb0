import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from umbra.functions import geometry as G
from umbra.operators import carriers, lines, mask

SMALL = "/root/testdata/sf0.001"
#: Queries that are quick on the smallest tables; the others are held against their SQL by the driver.
QUICK = ["runs_extract", "geo_covered_fraction", "val_codes", "pat_statement", "pat_custom", "book_context", "conflict_redact", "glyph_select", "effects_by_class", "review_items", "leaks_encoded", "annotations_split", "pdf_redact"]


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", QUICK)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "customer", "part", "orders", "lineitem", "events", "nation", "supplier", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "pattern_id", "hits", "docs"]


def test_appearances_names_and_filters(spark):
    regions = spark.createDataFrame([(1, 0, "Max  Muster"), (1, 1, None), (2, 2, "x")], "doc_id long, seq long, text string")
    looks = spark.createDataFrame([(1, 7, "by MaxMuster, signed"), (2, 8, "none")], "doc_id long, annotation long, text string")
    assert [(r.annotation, r.seq) for r in carriers.appearance_hits(looks, regions).collect()] == [(7, 0)]
    nodes = spark.createDataFrame([(1, 1, ["a", "r"]), (1, 2, ["b", "r", "c", "r"]), (1, 9, ["z", "r"])], "doc_id long, node long, names array<string>")
    reached = lines.reachable(spark.createDataFrame([(1, 1)], "doc_id long, node long"), spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 8, 9)], "doc_id long, src long, dst long"))
    assert [r.entries for r in carriers.name_tree_entries(nodes, reached).collect()] == [3]
    row = spark.range(1).select(
        carriers.image_filter(F.lit("DCTDecode")).alias("a"), carriers.decodable_filter(F.lit("LZW")).alias("b"), carriers.has_history(F.create_map(F.lit("Prev"), F.lit("1"))).alias("c"), carriers.has_history(F.create_map(F.lit("Root"), F.lit("1"))).alias("d")
    ).first()
    assert tuple(row) == (True, True, True, False)


def test_more_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 2.0, 2.0, 20.0, 8.0), (float("nan"), 0.0, 10.0, 10.0, 2.0, 2.0, 20.0, 8.0)], ", ".join(f"{n} double" for n in [*G.Rect._fields, *(f"o_{x}" for x in G.Rect._fields)]))
    a, b = G.rect(), G.rect("o_")
    hull, on = G.union(a, b), G.clamped(b, a)
    quad = [F.lit(v) for v in (0.0, 30.0, 30.0, 0.0)], [F.lit(v) for v in (0.0, 0.0, 30.0, 30.0)]
    rows = df.select(F.array(*hull).alias("hull"), F.array(*on).alias("on"), G.quad_covers(*quad, b).alias("q"), G.quad_covers([F.lit(v) for v in (0.0, 5.0, 5.0, 0.0)], quad[1], b).alias("n"), G.rotation(F.lit(-90)).alias("t"), G.rotation(F.lit(45)).alias("z"), mask.placeholder_size(b).alias("p")).collect()
    assert rows[0].hull == [0.0, 0.0, 20.0, 10.0] and rows[1].hull == [2.0, 0.0, 20.0, 10.0]
    assert rows[0].on == [2.0, 2.0, 10.0, 8.0] and (rows[0].q, rows[0].n, rows[0].t, rows[0].z, rows[0].p) == (True, False, 270, 0, 6 * 0.7)
    m = df.limit(1).select(*(c.alias(f"m{k}") for k, c in enumerate(G.matrix_multiply([F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 3.0, 4.0)], [F.lit(v) for v in (2.0, 0.0, 0.0, 2.0, 0.0, 0.0)]))), G.matrix_invert([F.lit(0.0)] * 6)[0].alias("none")).first()
    assert tuple(m) == (2.0, 0.0, 0.0, 2.0, 6.0, 8.0, None)

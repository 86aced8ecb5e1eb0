"""Rules for what else a file carries: annotations, text mirrors, images, names and earlier revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbra.functions import geometry as G
from umbra.functions.text import fold

#: By how much a colour key's range is widened before samples are counted in it.
KEY_MARGIN = 24
#: Parts of a document's notes from which the first ones are taken.
PARTS = 64


def split_annotations(annotations: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) of annotations (doc_id, page, annotation, rectangle): those that a region of their page meets go."""
    others = regions.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), *G.rect().named("r_"))
    meets = (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & G.intersects(G.rect(), G.rect("r_"))
    return annotations.join(others, meets, "left_anti"), annotations.join(others, meets, "left_semi")


def appearance_hits(appearances: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, annotation, seq): region texts that stand in an appearance's text, both without blanks, on any page."""
    wanted = regions.where(F.col("text").isNotNull()).select("doc_id", "seq", fold(F.col("text")).alias("needle")).where("needle <> ''")
    held = appearances.select("doc_id", "annotation", fold(F.col("text")).alias("held"))
    return held.join(wanted, "doc_id").where(F.contains("held", F.col("needle"))).select("doc_id", "annotation", "seq")


def mirrors_to_clear(marked: DataFrame, hidden: DataFrame) -> DataFrame:
    """Marked sections (doc_id, stream, section, first_op, last_op) that hold an operation (doc_id, stream, op) with a hidden glyph."""
    ops = hidden.select(F.col("doc_id").alias("d"), F.col("stream").alias("s"), "op")
    inside = (F.col("doc_id") == F.col("d")) & (F.col("stream") == F.col("s")) & F.col("op").between(F.col("first_op"), F.col("last_op"))
    return marked.join(ops, inside, "left_semi")


def overwrite_pixels(pixels: Column, width: Column, zone: G.Rect, colour: int) -> Column:
    """An image's pixels (rows of ``width``) with those whose cell meets the zone, in pixels, in one colour."""

    def cell(p: Column, k: Column) -> Column:
        x, y = k % width, F.floor(k / width)
        meets = (x < zone.urx) & (x + 1 > zone.llx) & (y < zone.ury) & (y + 1 > zone.lly)
        return F.when(meets, F.lit(colour)).otherwise(p)

    return F.transform(pixels, cell)


def key_reach(samples: Column, low: Column, high: Column) -> Column:
    """How many samples a colour key hides, its range widened on both sides."""
    return F.size(F.filter(samples, lambda s: s.between(low - KEY_MARGIN, high + KEY_MARGIN)))


def image_filter(name: Column) -> Column:
    return name.isin("DCTDecode", "DCT", "JPXDecode", "CCITTFaxDecode", "CCF", "JBIG2Decode")


def decodable_filter(name: Column) -> Column:
    return name.isin("FlateDecode", "Fl", "LZWDecode", "LZW", "ASCIIHexDecode", "AHx", "ASCII85Decode", "A85", "RunLengthDecode", "RL")


def has_history(trailer: Column) -> Column:
    """Whether a trailer (a map of its keys) tells of an earlier revision."""
    return F.exists(F.map_keys(trailer), lambda k: k.isin("Prev", "XRefStm"))


def name_tree_entries(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """(doc_id, entries): half the names of all tree nodes (doc_id, node, names) that were reached; each node counts once."""
    return nodes.join(reached.select("doc_id", "node").distinct(), ["doc_id", "node"], "left_semi").groupBy("doc_id").agg(F.sum(F.floor(F.size("names") / 2)).cast("long").alias("entries"))


def misread_streams(loaded: DataFrame, raw: DataFrame) -> DataFrame:
    """(doc_id, object, finding): streams that only one of two readings has, or that differ (doc_id, object, digest)."""
    both = loaded.withColumnRenamed("digest", "a").join(raw.withColumnRenamed("digest", "b"), ["doc_id", "object"], "full")
    finding = F.when(F.col("a").isNull(), "not loaded").when(F.col("b").isNull(), "not in the file").when(F.col("a") != F.col("b"), "differs")
    return both.select("doc_id", "object", finding.alias("finding")).where("finding is not null")


def capped_list(notes: DataFrame, most: int = 50) -> DataFrame:
    """(doc_id, notes): the first ``most`` notes (doc_id, seq, text) and a line for the rest. The cap is the feature.

    The first of each part of a document's notes are taken, then the first of these, so that no task gets all of one.
    """
    order = ["seq", "text"]
    parts = notes.withColumn("part", F.pmod(F.xxhash64("seq", "text"), F.lit(PARTS)))
    first = parts.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "part").orderBy(*order))).where(F.col("k") <= most)
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("k") <= most)
    listed = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("xs"))
    whole = listed.join(notes.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    texts = F.transform("xs", lambda x: x["text"])
    rest = F.array(F.concat(F.lit("and "), (F.col("n") - most).cast("string"), F.lit(" more")))
    return whole.select("doc_id", F.when(F.col("n") > most, F.concat(texts, rest)).otherwise(texts).alias("notes"))

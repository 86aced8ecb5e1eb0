"""Counts and short accounts of a run: hulls, placements, outcomes of hits, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import geometry as G

#: What can become of a hit, the first that fits.
OUTCOMES = ["disabled", "missing_page", "off_page", "redacted", "blocked", "duplicate"]


def hull(df: DataFrame, by: list[str]) -> DataFrame:
    """The bounding box of each group's rectangles; unusable ones are passed over, a group of only such has none."""
    r = G.rect()
    usable = lambda c: F.when(G.usable(r), c)
    return df.groupBy(*by).agg(F.min(usable(r.llx)).alias("llx"), F.min(usable(r.lly)).alias("lly"), F.max(usable(r.urx)).alias("urx"), F.max(usable(r.ury)).alias("ury"))


def hidden_once(hidden: DataFrame) -> DataFrame:
    """(doc_id, stream, glyphs, operations) of hidden glyphs (doc_id, stream, placement, op, glyph): a stream that is drawn
    at several places loses what any of them hides, and each glyph counts once."""
    once = hidden.select("doc_id", "stream", "op", "glyph").distinct()
    return once.groupBy("doc_id", "stream").agg(F.count("*").alias("glyphs"), F.count_distinct("op").alias("operations"))


def property_homes(uses: DataFrame, resources: DataFrame) -> DataFrame:
    """(doc_id, stream, name, object): where the property list lies that a marked section (doc_id, stream, owner, name) uses.

    ``resources``: (doc_id, owner, name, object). A name that its owner doesn't know has no home.
    """
    return uses.join(resources, ["doc_id", "owner", "name"]).select("doc_id", "stream", "name", "object").distinct()


def invisible_glyph(text: Column, code: Column, code_bytes: Column) -> Column:
    """Whether a glyph shows nothing: only invisible characters, or an unreadable one from a control code of one byte."""
    from umbra.functions.text import INVISIBLE

    blank = (text != "") & (F.regexp_replace(text, INVISIBLE, "") == "")
    return blank | ((text == "�") & (code_bytes == 1) & ((code < 32) | (code == 127)))


def non_white_ratio(pixels: Column, white: int = 255) -> Column:
    """The share of an image's samples that aren't white; of no samples, none."""
    painted = F.size(F.filter(pixels, lambda p: p < white))
    return F.when(F.size(pixels) > 0, painted / F.size(pixels)).otherwise(0.0)


def plain_description(kind: Column, ref: Column, match_type: Column) -> Column:
    """A region's source in words."""
    return (
        F.when(kind == "pattern", F.concat(F.lit("found by the pattern "), ref))
        .when((kind == "booking") & (match_type == "negative"), F.concat(F.lit("must stay, by the list entry "), ref))
        .when(kind == "booking", F.concat(F.lit("on the list, entry "), ref))
        .otherwise(F.when(F.coalesce(ref, F.lit("")) == "", "marked by hand").otherwise(F.concat(F.lit("marked by hand: "), ref)))
    )


def outcomes(regions: DataFrame, kept: DataFrame, blocked: DataFrame, effects: DataFrame, disabled: DataFrame | None = None) -> DataFrame:
    """``regions`` (doc_id, page, seq, ...) that aren't negative entries, with the ``outcome`` of each.

    ``kept`` and ``blocked`` come from the resolution, ``effects`` (doc_id, page, seq, effect) from the run; ``disabled``
    names the regions that were switched off.
    """
    key = ["doc_id", "page", "seq"]
    mark = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    own = regions.where(~((F.col("kind") == "booking") & F.coalesce(F.col("match_type") == "negative", F.lit(False))))
    out = own.join(mark(kept, "_kept"), key, "left").join(mark(blocked, "_blocked"), key, "left").join(effects.select(*key, "effect").distinct(), key, "left")
    out = out.join(mark(disabled, "_off"), key, "left") if disabled is not None else out.withColumn("_off", F.lit(None).cast("boolean"))
    outcome = (
        F.when(F.col("_off"), "disabled").when(F.col("_kept") & F.col("effect").isin("missing_page", "off_page"), F.col("effect"))
        .when(F.col("_kept"), "redacted").when(F.col("_blocked"), "blocked").otherwise("duplicate")
    )
    return out.withColumn("outcome", outcome).drop("_kept", "_blocked", "_off", "effect")


def hit_summary(found: DataFrame) -> DataFrame:
    """One row: how many hits had each outcome."""
    return found.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES), F.count("*").alias("hits"))


def redactions_per_page(found: DataFrame) -> DataFrame:
    """(doc_id, page, redactions) of pages with a hit."""
    return found.groupBy("doc_id", "page").agg(F.count_if(F.col("outcome") == "redacted").alias("redactions"))

"""What each region really did, and the reports that say so: effects, warnings, audit log and review file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbra.functions import geometry as G
from umbra.operators.conflict import reason, source_kind
from umbra.operators.mask import REDACTION_PADDING

EFFECTS = ["missing_page", "degenerate", "off_page", "applied", "covered"]
REVIEW_VERSION = 1
#: What a warning may say without being a gap in what was looked at.
HARMLESS = ["encoded anew", "copy made", "box replaced"]
MAX_MESSAGES, MAX_UNCHECKED = 200, 50


def effect(pages: Column, padding: float = REDACTION_PADDING) -> Column:
    """The first of these that holds: no such page, nothing left after padding, beside the sheet, else by what was hidden."""
    r = G.rect()
    return (
        F.when(pages.isNull() | (F.col("page") >= pages) | (F.col("page") < 0), "missing_page")
        .when(G.empty(G.expanded(r, padding)), "degenerate")
        .when(G.beside(r, G.rect("sheet_")), "off_page")
        .when(F.col("removed_glyphs") > 0, "applied")
        .otherwise("covered")
    )


def with_effects(counted: DataFrame, boxes: DataFrame, padding: float = REDACTION_PADDING) -> DataFrame:
    """Regions with ``removed_glyphs`` and ``effect``. ``boxes``: (doc_id, pages, sheet_...), one row a document."""
    return counted.join(boxes, "doc_id", "left").withColumn("effect", effect(F.col("pages"), padding)).drop("sheet_llx", "sheet_lly", "sheet_urx", "sheet_ury")


def measure(effects: DataFrame) -> DataFrame:
    """One row a document: regions by effect, those without any, and the pages concerned, from 0."""
    pages = lambda what: F.array_sort(F.collect_set(F.when(F.col("effect") == what, F.col("page"))))
    out = effects.groupBy("doc_id").agg(
        F.count("*").alias("requested"),
        *(F.count_if(F.col("effect") == e).alias(e) for e in EFFECTS),
        F.sum("removed_glyphs").cast("long").alias("removed_glyphs"),
        pages("missing_page").alias("missing_pages"),
        pages("off_page").alias("off_page_pages"),
        F.max("pages").alias("pages"),
    )
    return out.withColumn("ineffective", F.col("degenerate") + F.col("missing_page") + F.col("off_page"))


def warnings(measured: DataFrame, padding: float = REDACTION_PADDING) -> DataFrame:
    """``measured`` with a text for every class of region that had no or only a partial effect. Texts count pages from 1."""
    human = lambda pages: F.array_join(F.transform(pages, lambda p: (p + 1).cast("string")), ", ")
    of = lambda n: F.concat(n.cast("string"), F.lit(" of "), F.col("requested").cast("string"), F.lit(" regions "))
    texts = F.array(
        F.when(F.col("missing_page") > 0, F.concat(of(F.col("missing_page")), F.lit("are on pages that don't exist (page "), human("missing_pages"), F.lit("; pages: "), F.col("pages").cast("string"), F.lit(")"))),
        F.when(F.col("degenerate") > 0, F.concat(of(F.col("degenerate")), F.lit(f"are empty after a padding of {padding}"))),
        F.when(F.col("off_page") > 0, F.concat(of(F.col("off_page")), F.lit("lie beside their page (page "), human("off_page_pages"), F.lit(")"))),
        F.when(F.col("covered") > 0, F.concat(of(F.col("covered")), F.lit("cover no character"))),
    )
    return measured.withColumn("warnings", F.filter(texts, lambda t: t.isNotNull()))


def gaps(messages: Column) -> Column:
    """The messages that tell of something that wasn't inspected."""
    harmless = lambda m: F.exists(F.array(*map(F.lit, HARMLESS)), lambda h: F.contains(m, h))
    return F.filter(messages, lambda m: ~harmless(m))


def fully_inspected(messages: Column) -> Column:
    return F.size(gaps(messages)) == 0


def healed_pages(notes: DataFrame) -> DataFrame:
    """(doc_id, note, pages, first_page): page notes of equal wording together."""
    return notes.groupBy("doc_id", "note").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.min("page").alias("first_page"))


def distinct_messages(messages: DataFrame, most: int = MAX_MESSAGES) -> DataFrame:
    """(doc_id, text, seq): each wording once, at its first place, the first ``most`` of a document. The cap is the feature."""
    once = messages.groupBy("doc_id", "text").agg(F.min("seq").alias("seq"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "text"))).where(F.col("k") <= most).drop("k")


def audit_entries(effects: DataFrame) -> DataFrame:
    """One row for every protected region, as the audit log lists it. A hidden text is not told."""
    return effects.select(
        "doc_id", "seq", "page", source_kind(F.col("kind")).alias("source"), reason(F.col("kind"), F.col("ref"), F.col("match_type"), F.col("confidence")).alias("reason"), "effect", "removed_glyphs", F.struct(*G.rect().named()).alias("rect")
    )


def audit_log(entries: DataFrame, blocked: DataFrame, measured: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, sha256, log): the audit document of every text as JSON."""
    listed = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "page", "source", "reason", "effect", "removed_glyphs", "rect"))).alias("redactions"))
    stopped = blocked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "page", "pattern", "booking_id", "blocked_reason"))).alias("blocked"))
    inputs = texts.select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"), F.octet_length("text").alias("bytes"))
    whole = inputs.join(listed, "doc_id", "left").join(stopped, "doc_id", "left").join(warnings(measured), "doc_id", "left")
    strip = lambda xs: F.transform(xs, lambda x: x.dropFields("seq"))
    log = F.struct(
        F.struct("sha256", "bytes").alias("input"),
        strip("redactions").alias("redactions"),
        strip("blocked").alias("blocked_by_negative_list"),
        F.struct("requested", *EFFECTS, "ineffective", "removed_glyphs").alias("effect"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )
    return whole.select("doc_id", "sha256", F.to_json(log).alias("log"))


REVIEW_SCHEMA = (
    "version int, input struct<path:string,sha256:string,pages:bigint>, "
    "items array<struct<id:string,enabled:boolean,action:string,region:struct<page:bigint,llx:double,lly:double,urx:double,ury:double,text:string,kind:string,ref:string,match_type:string,confidence:double>>>"
)


def review_files(regions: DataFrame, texts: DataFrame, boxes: DataFrame, action: str = "blackout") -> DataFrame:
    """(doc_id, review): the regions of every document as a review file, all enabled, numbered in their order."""
    region = F.struct("page", *G.rect().named(), "text", "kind", "ref", "match_type", "confidence")
    listed = regions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", region.alias("region")))).alias("xs"))
    items = F.transform("xs", lambda x, k: F.struct(F.format_string("r%05d", k + 1).alias("id"), F.lit(True).alias("enabled"), F.lit(action).alias("action"), x["region"].alias("region")))
    whole = texts.select("doc_id", F.sha2(F.col("text"), 256).alias("sha256")).join(listed, "doc_id").join(boxes.select("doc_id", "pages"), "doc_id", "left")
    document = F.struct(F.lit(REVIEW_VERSION).alias("version"), F.struct(F.col("doc_id").cast("string").alias("path"), "sha256", "pages").alias("input"), items.alias("items"))
    return whole.select("doc_id", F.to_json(document).alias("review"))


def read_reviews(files: DataFrame) -> DataFrame:
    """(doc_id, sha256, item, page, rectangle, text, kind, ref, match_type, confidence, action) of the enabled items.

    Files of another version are an error; rectangles are put the right way round; negative hits aren't protected.
    """
    parsed = files.select("doc_id", F.from_json("review", REVIEW_SCHEMA).alias("r"))
    checked = parsed.where(F.when(F.coalesce(F.col("r.version"), F.lit(0)) != REVIEW_VERSION, F.raise_error(F.lit("unknown review version"))).otherwise(F.lit(True)))
    items = checked.select("doc_id", F.col("r.input.sha256").alias("sha256"), F.posexplode("r.items").alias("item", "i")).where("i.enabled")
    flat = items.select("doc_id", "sha256", "item", "i.action", "i.region.*")
    r = G.from_corners(F.col("llx"), F.col("lly"), F.col("urx"), F.col("ury"))
    out = flat.withColumns(dict(zip([f"n{k}" for k in range(4)], r, strict=True)))
    out = out.select("doc_id", "sha256", "item", "action", "page", *(F.col(f"n{k}").alias(n) for k, n in enumerate(G.Rect._fields)), "text", "kind", "ref", "match_type", "confidence")
    return out.where(~((F.col("kind") == "booking") & F.coalesce(F.col("match_type") == "negative", F.lit(False))))


def identity(reviewed: DataFrame, texts: DataFrame, allow_unverified: bool = False) -> DataFrame:
    """(doc_id, identity): whether a review belongs to the text at hand. A mismatch is an error for ``enforced``."""
    own = texts.select("doc_id", F.sha2(F.col("text"), 256).alias("own"))
    both = reviewed.select("doc_id", "sha256").distinct().join(own, "doc_id", "left")
    outcome = F.when(F.col("sha256").isNull() | F.col("own").isNull(), "unverified").when(F.lower("sha256") == F.col("own"), "match").otherwise("mismatch")
    return both.select("doc_id", outcome.alias("identity")).withColumn("accepted", (F.col("identity") == "match") | ((F.col("identity") == "unverified") & F.lit(allow_unverified)))


def exit_codes(status: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each group of ``by``: 1 if anything failed, else 3 if anything is incomplete, else 0."""
    code = F.when(F.coalesce(F.bool_or("failed"), F.lit(False)), 1).when(F.coalesce(F.bool_or("incomplete"), F.lit(False)), 3).otherwise(0)
    return status.groupBy(*(by or [])).agg(code.alias("exit_code"))


def output_collisions(plan: DataFrame) -> DataFrame:
    """(output, inputs, collides, over_input): outputs that several inputs name, or that are an input themselves."""
    grouped = plan.groupBy("output").agg(F.array_sort(F.collect_list("input")).alias("inputs"))
    over = grouped.join(plan.select(F.col("input").alias("output")).distinct().withColumn("over_input", F.lit(True)), "output", "left")
    return over.select("output", "inputs", (F.size("inputs") > 1).alias("collides"), F.coalesce("over_input", F.lit(False)).alias("over_input"))

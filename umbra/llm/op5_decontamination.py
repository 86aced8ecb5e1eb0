"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units behind or before them, and names (words of a capital and small letters, wherever they stand) become typed
placeholders that remember what they stand for; case and punctuation go. A window is ``WINDOW`` tokens, or a whole item
of fewer. Windows of both sides meet in a hash join under two keys: with names as placeholders, and with names as
ordinary words in small letters, so that a first word of a sentence, or a text in small letters, doesn't hide a copy. A
window of nothing but placeholders has its values in its key, as placeholders alone prove nothing.

A document contains an item if one of its regions holds at least ``CONTAINMENT`` of all the item's windows with slots
filled consistently: wherever the item repeats a value, the document repeats the value that mostly stands for it;
windows that break this don't count. So a question whose numbers, units and names were exchanged is still found. Regions
are bands of offsets (position in the document less position in the item), L + 2 and 2 L + 2 wide for an item of L
tokens, one at every half of that: a copy with up to L tokens put in or taken out lies in one of them, and copies with
other values right beside it stay out of one of the narrow ones. An item with fewer than ``LEAST_WORDS`` ordinary words
has to be there with its own values.

All windows of a document take part, and each met window carries its tokens, so documents are read and cut once.

Defined cases: null and empty texts have no windows and match nothing; texts of any length are read whole; rows of one
document id are judged by their own texts, and ``find`` gives the best of them; rows without a document id are judged
too, and ``find`` gives one row for each different text; several texts of one item id are looked for each, and the
best counts; items without an id are not looked for; an item of one token is found wherever that token stands; empty
tables give no rows. Clashing extra columns of either table play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import cut, table

WINDOW, CONTAINMENT, LEAST_WORDS = 5, 0.8, 3
#: A benchmark of at most this many windows is broadcast (some 300 bytes each); a larger one is joined by a shuffle.
MAX_BROADCAST_WINDOWS = 200_000
#: The same for found rows (24 bytes each).
MAX_BROADCAST_FOUND = 1_000_000
_UNITS = "kg|mg|g|lbs|lb|oz|km|cm|mm|m|miles|mile|mi|feet|foot|ft|inches|inch|yards|yard|litres|liters|ml|l|gallons|hours|hour|hrs|hr|h|minutes|minute|min|seconds|second|sec|s|ms|days|day|weeks|week|months|month|years|year|mph|percent|dollars|dollar|cents|euros|euro|pounds|usd|eur|gbp|%|°c|°f"
#: What a placeholder token begins with, and a number's decimal point or comma. Ordinary words are not below U+0004.
NUMBER, NAME, UNIT, POINT = "\u0001", "\u0002", "\u0003", "\u0004"
_WORD = "\u0005"


def tokens(text: Column) -> Column:
    """The tokens of a text in order, placeholders with their values behind the mark of their type."""
    marks = NUMBER + NAME + UNIT + POINT + _WORD
    marked = reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in marks))
    out = F.when(marked, F.translate(text, marks, " " * len(marks))).otherwise(text)
    out = F.regexp_replace(out, r"(\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Ll}\p{L}*)", f"{NAME}$1")
    out = F.regexp_replace(out, r"(?<=\d)[.,](?=\d)", POINT)
    out = F.regexp_replace(out, rf"(?i)(?<![\d{POINT}])(\d[\d{POINT}]*)\s?{NAME}?({_UNITS})(?![\p{{L}}\d])", f" {NUMBER}$1 {UNIT}$2 ")
    out = F.regexp_replace(out, rf"([$€£])\s?(?=[{NUMBER}\d])", f" {UNIT}$1 ")
    out = F.regexp_replace(out, rf"(?<![\d{NUMBER}{POINT}])(\d[\d{POINT}]*)", f" {NUMBER}$1 ")
    return F.array_remove(F.split(F.lower(out), rf"[^\p{{L}}\p{{M}}\p{{N}}$€£%°{NUMBER}-{POINT}]+"), "")


def _plain(word: Column) -> Column:
    return F.when(word >= _WORD, word).otherwise(F.substring(word, 1, 1))


def _named(word: Column) -> Column:
    return F.when(word >= _WORD, word).when(word.startswith(NAME), F.substring(word, 2, 1 << 30)).otherwise(F.substring(word, 1, 1))


def _keys(words: list[Column], of=F.xxhash64) -> Column:
    """One or two keys of a window: names as placeholders, and names as words."""
    template = F.when(F.greatest(F.lit(""), *words) >= _WORD, of(*map(_plain, words))).otherwise(of(*words))
    names = reduce(lambda a, b: a | b, (F.coalesce(w.startswith(NAME), F.lit(False)) for w in words))
    return F.when(names, F.array(template, of(*map(_named, words)))).otherwise(F.array(template))


def _windows(words: str) -> Column:
    """(position, tokens) of all windows; those at a text's end are shorter, with nulls for what is missing."""
    # The outer form keeps the optimiser from cutting every text twice, for a filter on the number of windows.
    return F.posexplode_outer(F.arrays_zip(*(F.slice(words, k + 1, F.size(words)) for k in range(WINDOW))))


def _tokens_of(window: str) -> list[Column]:
    return [F.col(window).getField(str(k)) for k in range(WINDOW)]


def _text_key(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, variant, length, own_values, n_windows, ipos, slots) of all windows of the benchmark's different texts."""
    coded = items.where(F.col("item_id").isNotNull()).select("item_id", _text_key(F.col("text")).alias("variant"), tokens(F.col("text")).alias("w"))
    words = F.size(F.array_distinct(F.filter("w", lambda w: w >= _WORD)))
    coded = coded.dropDuplicates(["item_id", "variant"]).where(F.size("w") > 0).withColumn("length", F.size("w")).withColumn("own_values", words < LEAST_WORDS)
    coded = coded.withColumn("n_windows", F.greatest(F.col("length") - WINDOW + 1, F.lit(1)))
    return coded.select("item_id", "variant", "length", "own_values", "n_windows", _windows("w").alias("ipos", "slots")).where("ipos < n_windows")


def _met(documents: DataFrame, known: DataFrame, small: bool, short: list[int]) -> DataFrame:
    """Pairs of a document's and an item's window under one key, with what fills the item's slots.

    ``short``: the lengths of items that are shorter than a window.
    """
    coded = documents.select("doc_id", _text_key(F.col("text")).alias("text_key"), tokens(F.col("text")).alias("w"))
    every = coded.select("doc_id", "text_key", _windows("w").alias("dpos", "filled")).where("filled is not null")
    words = _tokens_of("filled")
    # Beginnings of windows are only made for benchmarks that have such short items.
    keys = _keys(words)
    if short:
        keys = F.array_distinct(F.concat(keys, *(F.when(words[n].isNotNull(), _keys(words[:n])).otherwise(F.array().cast("array<bigint>")) for n in short)))
    every = every.withColumn("key", F.explode(keys))
    wanted = known.withColumn("key", F.explode(_keys(_tokens_of("slots"))))
    # Cut here, as the comparison below would make the scan's generated code too long to be compiled.
    met = cut(every.join(F.broadcast(wanted) if small else wanted, "key").drop("key"))
    # Equal keys are hashes; here the windows themselves are compared.
    slots, words = _tokens_of("slots"), [F.when(F.col("length") > k, w) for k, w in enumerate(words)]
    text = lambda *w: F.array_join(F.array(*w), " ")
    met = met.where(F.arrays_overlap(_keys(words, text), _keys(slots, text)))
    pair = lambda s, d: F.when((s < POINT) & (F.substring(s, 1, 1) == F.substring(d, 1, 1)), F.struct(s.alias("slot"), d.alias("value")))
    pairs = F.array_compact(F.array(*(pair(s, d) for s, d in zip(slots, words, strict=True))))
    return met.select("doc_id", "text_key", "item_id", "variant", "length", "own_values", "n_windows", "ipos", "dpos", pairs.alias("pairs")).distinct()


def _best(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, matched, n_windows, changed_slots): the best of each text's regions for each item."""
    known = cut(item_windows(items.select("item_id", "text")))
    small = known.count() <= MAX_BROADCAST_WINDOWS
    short = [r.length for r in known.where(F.col("length") < WINDOW).select("length").distinct().collect()]  # four numbers at most
    met = cut(_met(documents, known, small, sorted(short)))

    # Ids can be null, so regions are named by one hash of all that tells them apart.
    steps = [(F.col("length") / 2).cast("int") + 1, F.col("length") + 1]
    band = lambda k, back: F.struct(F.lit(k).alias("kind"), (F.floor((F.col("dpos") - F.col("ipos")) / steps[k]) - back).alias("band"))
    met = met.withColumn("region", F.explode(F.array(*(band(k, back) for k in (0, 1) for back in (0, 1)))))
    met = met.withColumn("place", F.struct(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text_key", "item_id", "variant", "region"), "text_key", "variant", "region"))
    enough = lambda n: n >= CONTAINMENT * F.col("n_windows") - 1e-9
    full = met.groupBy("place", "n_windows").agg(F.count_distinct("ipos").alias("n")).where(enough(F.col("n"))).select("place")
    met = cut(met.join(full, "place", "left_semi"))

    filled = met.select("place", "ipos", "dpos", F.explode("pairs").alias("p")).select("place", "ipos", "dpos", "p.slot", "p.value")
    uses = filled.groupBy("place", "slot", "value").agg(F.count("*").alias("n"))
    bound = uses.groupBy("place", "slot").agg(F.max_by("value", F.struct("n", F.col("slot") == F.col("value"), "value")).alias("stands"))
    broken = filled.join(bound, ["place", "slot"]).where("value <> stands").select("place", "ipos", "dpos").distinct()
    changed = bound.groupBy("place").agg(F.count_if(F.col("slot") != F.col("stands")).alias("changed"))
    good = met.join(broken, ["place", "ipos", "dpos"], "left_anti")
    regions = good.groupBy("place", "doc_id", "text_key", "item_id", "own_values", "n_windows").agg(F.count_distinct("ipos").alias("matched")).where(enough(F.col("matched")))
    regions = regions.join(changed, "place", "left").withColumn("changed", F.coalesce("changed", F.lit(0))).where(~F.col("own_values") | (F.col("changed") == 0))
    share = F.struct((F.col("matched") / F.col("n_windows")).alias("share"), (-F.col("changed")).alias("fewer"), "matched", "n_windows")
    best = regions.groupBy("doc_id", "text_key", "item_id").agg(F.max(share).alias("b"))
    return best.select("doc_id", "text_key", "item_id", "b")


def find(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, n_windows, containment, changed_slots): the items that documents contain."""
    best = _best(documents.select("doc_id", "text"), items)
    own = F.when(F.col("doc_id").isNull(), F.col("text_key"))
    best = best.groupBy("doc_id", own.alias("own"), "item_id").agg(F.max("b").alias("b"))
    return best.select(
        "doc_id", "item_id", F.col("b.matched").alias("matched"), F.col("b.n_windows").alias("n_windows"), F.col("b.share").alias("containment"), (-F.col("b.fewer")).alias("changed_slots")
    )


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``documents`` without the rows whose text contains an item."""
    found = cut(_best(documents.select("doc_id", "text"), items).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    few = found.count() <= MAX_BROADCAST_FOUND
    same = documents["doc_id"].eqNullSafe(F.col("_id")) & (_text_key(documents["text"]) == F.col("_key"))
    return documents.join(F.broadcast(found) if few else found, same, "left_anti").select(documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Near-duplicate groups by bottom-k sketches of one hash function.

1. A document's set is the 64-bit hashes of its distinct word shingles; its sketch is the ``SKETCH`` smallest of them.
   Documents with equal sets form a class, and only one of each class goes on.
2. Two sets as similar as asked for share at least ``least_shared`` sketch values, but for one pair in 10**9; sets that
   fit into a sketch share a number that follows from their size. So with the values ordered by how many sketches
   retain them, rarest first, the two have a value in common among the first (retained - shared + 1) of each: these go
   into the inverted lists, and frequent passages stay out of nearly all of them.
3. The documents of lists longer than ``LONG`` get longer sketches, which retain all their values (bottom-k with k the
   size of the set), and are listed by these in the same way; the number that such sets must share is exact then.
4. In each list all documents are paired with its first one. Pairs of fitting size pass if the estimate from the union
   of the two sketches allows it, and link if the exact Jaccard similarity of the full sets is high enough.
5. Linked documents grow together to components. Lists that then hold several components are searched for links
   between these: short lists pair by pair, long ones in tiles of ``BLOCK`` by ``BLOCK`` documents. A tile first
   multiplies the sketches as matrices, and what these rule out goes no further; then the full sets of what is left, and
   gives only the links that join something. So no pairs within a component are made.

Nothing is capped, so no list loses a link. Values and sets of which one has a large part of the rows meet their counts
by a broadcast of the few that are so frequent, so that no task gets all rows of one. Each step's shuffle files are
deleted when its result is written, and its result when nothing needs it any more.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; one with fewer words than a
shingle has its whole sequence as its one shingle; equal texts always share a component; rows of one id count as one
document and are all returned, and so are rows without an id that have the same text. These are judged like all others
but come behind all ids, so their component is null if it has no document with an id, and they are kept only then and if
they are the first of it. An empty table gives no rows. Extra columns of the input stay, but those named like a result
are replaced. Ids are strings, or numbers below 2**63 - 2**60.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from umbra.llm.common import join_counted, slices, table
from umbra.llm.graph import components
from umbra.llm.text_hashes import Remembered, mix
from umbra.plans.storage import release, step, tidy

SKETCH, LONG, BLOCK = 48, 64, 1024
#: Values that a tile's matrix holds at a time, and those of the sets on a side of a tile.
COLUMNS, TILE_VALUES = 2_048, 800_000
#: The part of linked pairs that a filter on sketches may miss at most.
MISSED = 1e-9
#: Ids up to this number (16 MB) are broadcast, more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000
LONGS = ArrayType(LongType())
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HASHES = Remembered(xxhash.xxh3_64_intdigest)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The ascending hashes of a whole text's distinct shingles. Words are parted by ASCII white space only."""
    found = _HASHES.of((text or "").encode().translate(_LOWER).split())
    if not len(found):
        return found
    n = min(words, len(found))
    at = mix(found[: len(found) - n + 1] + np.uint64(n))
    for k in range(1, n):
        at = mix(at + found[k : len(found) - n + 1 + k])
    return np.unique(at)


def least_shared(similarity: Fraction) -> int:
    """How many of their sketch values two sets of this similarity share at least, but for ``MISSED`` of such pairs."""
    total, p = 0.0, float(similarity)
    for shared in range(SKETCH + 1):
        total += math.comb(SKETCH, shared) * p**shared * (1 - p) ** (SKETCH - shared)
        if total > MISSED:
            return shared
    return SKETCH


def sketches(df: DataFrame, words: int, text: str = "text") -> DataFrame:
    """``df`` without its text, but with ``n_shingles``, the set's ``digest`` and its ``sketch``."""
    kept = [x for x in df.columns if x not in (text, "n_shingles", "digest", "sketch")]
    schema = df.select(kept).schema.add("n_shingles", "long").add("digest", "binary").add("sketch", LONGS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _HASHES.during(slices(batches)):
            sets = [shingle_set(x, words) for x in batch.column(text).to_pylist()]
            arrays = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *arrays], [*kept, "n_shingles", "digest", "sketch"])

    return df.mapInArrow(work, schema)


def full_sets(documents: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, whole): the full sets of the documents named in ``ids`` (id), one row an id."""
    small = ids.count() <= MAX_BROADCAST_IDS
    named = documents.join(F.broadcast(ids) if small else ids, "id", "left_semi")
    schema = named.select("id").schema.add("whole", LONGS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _HASHES.during(slices(batches)):
            sets = [shingle_set(x, words).view(np.int64) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "whole"])

    return named.select("id", "text").mapInArrow(work, schema)


@tidy
def _first_values(postings: DataFrame, first: Column) -> DataFrame:
    """(value, id, n) of the values to list: the first ``first`` of an id's values, rarest first, but no single ones.

    ``postings``: (value, id, n, retained), n being the size of the set and ``retained`` that of the values' list.
    """
    shared = step(postings.groupBy("value").agg(F.count("*").alias("often")).where("often > 1"))
    common = join_counted(postings, shared, "value", "often").groupBy("id", "n", "retained").agg(F.array_sort(F.collect_list(F.struct("often", "value"))).alias("values"))
    # Values that only one document has come first in the order and pair with nothing.
    left = first - (F.col("retained") - F.size("values"))
    listed = common.where(left > 0).select("id", "n", F.explode(F.slice("values", F.lit(1), left.cast("int"))).alias("x"))
    return listed.select("x.value", "id", "n")


@tidy
def _lists(postings: DataFrame, first: Column) -> DataFrame:
    """The ``_first_values`` that more than one document lists, with the ``first`` id and the ``length`` of the list."""
    listed = _first_values(postings, first)
    heads = step(listed.groupBy("value").agg(F.count("*").alias("length"), F.min("id").alias("first")).where("length > 1"))
    return join_counted(listed, heads, "value", "length")


def _fits(a: str, b: str, similarity: Fraction) -> Column:
    """Whether sets of these sizes can be similar enough."""
    p, q = similarity.numerator, similarity.denominator
    return F.least(a, b) * q >= F.greatest(a, b) * p


@tidy
def _verified(pairs: DataFrame, reps: DataFrame, documents: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """The linked ones of ``pairs`` (a, b): by the union sketch's estimate, then by the full sets."""
    p, q = similarity.numerator, similarity.denominator
    sketch = reps.select("id", "sketch")
    both = pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
    union = F.slice(F.array_sort(F.transform(F.array_union("sa", "sb"), lambda x: F.struct((x < 0).alias("high"), x.alias("x")))), 1, SKETCH)
    union = F.transform(union, lambda s: s["x"])
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    passed = step(both.where((shared >= least_shared(similarity)) | (F.size(union) < SKETCH)).select("a", "b"))
    ids = passed.select(F.col("a").alias("id")).union(passed.select("b")).distinct()
    whole = full_sets(documents, step(ids), words)
    # The pairs meet one set after the other, so that a set in many pairs is split like any hot key.
    met = passed.join(whole.toDF("a", "wa"), "a").join(whole.toDF("b", "wb"), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return met.where(common * q >= (F.size("wa") + F.size("wb") - common) * p).select("a", "b")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``a`` has in common with each of ``b``, as products of slices of their incidence matrices."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    at = [[np.searchsorted(both, s[np.isin(s, both)]) for s in sets] for sets in (a, b)]
    common = np.zeros((len(a), len(b)), np.int64)
    for begin in range(0, len(both), COLUMNS):
        hits = [np.zeros((len(sets), COLUMNS), np.float32) for sets in at]
        for m, sets in zip(hits, at, strict=True):
            for k, s in enumerate(sets):
                m[k, s[(s >= begin) & (s < begin + COLUMNS)] - begin] = 1
        common += (hits[0] @ hits[1].T).astype(np.int64)
    return common


def _sides(tile):
    """The rows and columns of a tile (a pandas table; pandas is loaded by the tiles' workers only)."""
    return tuple(tile[tile.side == k].drop_duplicates("id") for k in (0, 1))


def _tile_candidates(similarity: Fraction):
    """The documents of a tile whose sketches allow a link with one of another component on the other side."""
    p, q, least = similarity.numerator, similarity.denominator, least_shared(similarity)

    def work(tile):
        rows, cols = _sides(tile)
        if not len(rows) or not len(cols):
            return tile.drop(columns="sketch").head(0)
        a, b = list(rows.sketch), list(cols.sketch)
        common = _overlaps(a, b)
        union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - common
        n, m = rows.n.to_numpy()[:, None], cols.n.to_numpy()[None, :]
        fits = np.minimum(n, m) * q >= np.maximum(n, m) * p
        passed = ((common >= least) | (union < SKETCH)) & fits & (rows.component.to_numpy()[:, None] != cols.component.to_numpy()[None, :])
        import pandas as pd

        return pd.concat([rows[passed.any(axis=1)], cols[passed.any(axis=0)]]).drop(columns="sketch")

    return work


def _tile_links(similarity: Fraction):
    """Links between components on a tile's two sides, but only those that join something."""
    p, q = similarity.numerator, similarity.denominator

    def work(tile):
        rows, cols = _sides(tile)
        out = []
        if len(rows) and len(cols):
            a, b = list(rows.whole), list(cols.whole)
            common = _overlaps(a, b)
            linked = common * q >= (np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - common) * p
            root = {}

            def find(x):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for i, j in np.argwhere(linked):
                x, y = find(rows.component.iat[i]), find(cols.component.iat[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((rows.id.iat[i], cols.id.iat[j]))
        import pandas as pd

        return pd.DataFrame(out, columns=["a", "b"])

    return work


@tidy
def _between(lists: DataFrame, grown: DataFrame, reps: DataFrame, documents: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """Links between different components that meet in a list."""
    placed = step(lists.join(grown, "id", "left").select("value", "id", "n", "first", "length", F.coalesce("component", "id").alias("component")))
    mixed = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("many"), F.sum("n").alias("values"))
    mixed = step(mixed.where("low <> high").select("value", "many", "values"))
    open_ = step(join_counted(placed, mixed, "value", "many"))
    short = open_.where(F.col("length") <= LONG)
    x, y = short.select("value", "id", "n", "component", "first"), short.select("value", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "component")))
    # Pairs with the list's first document have been looked at. At most LONG rows of y meet a row of x.
    pairs = x.join(y, "value").where((F.col("id") < F.col("id2")) & (F.col("id") != F.col("first")) & (F.col("component") != F.col("component2")) & _fits("n", "n2", similarity))
    links = _verified(pairs.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct(), reps, documents, words, similarity)

    long_ = open_.where(F.col("length") > LONG)
    sizes = long_.groupBy("value", "component").agg(F.count("*").alias("share"))
    main = step(sizes.groupBy("value").agg(F.max_by("component", F.struct("share", "component")).alias("main"), F.sum("share").alias("total")))
    # A side of a tile has about BLOCK documents with TILE_VALUES values in all, so its memory is bounded.
    blocks = F.ceil(F.greatest(F.col("length") / BLOCK, F.col("values") / TILE_VALUES)).cast("int")
    sided = step(join_counted(long_, main, "value", "total").withColumn("blocks", blocks))
    # The main component's documents need no pairs among themselves: rows are all the others, columns are all.
    slot = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = sided.where("component <> main").select("value", "id", "n", "component", F.lit(0).alias("side"), slot(1).alias("i"), F.explode(every).alias("j"))
    columns = sided.select("value", "id", "n", "component", F.lit(1).alias("side"), F.explode(every).alias("i"), slot(2).alias("j"))
    tiles = rows.unionByName(columns)
    passed = step(tiles.join(reps.select("id", "sketch"), "id").groupBy("value", "i", "j").applyInPandas(_tile_candidates(similarity), tiles.schema))
    wholes = full_sets(documents, step(passed.select("id").distinct()), words)
    schema = reps.select(F.col("id").alias("a"), F.col("id").alias("b")).schema
    found = passed.join(wholes, "id").groupBy("value", "i", "j").applyInPandas(_tile_links(similarity), schema)
    return links.union(found)


def _unnamed(doc_id: str, text: str, df: DataFrame) -> Column:
    """A key for rows without an id, behind all ids of the same type: from the text, so equal texts are one document."""
    if isinstance(df.schema[doc_id].dataType, StringType):
        return F.concat(F.lit(chr(0x10FFFF)), F.sha2(F.coalesce(text, F.lit("")), 256))
    return (F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << 60))).cast("long")


def members(df: DataFrame, words: int = 5, similarity: Fraction = Fraction(8, 10), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, unnamed, n_shingles, component_id, kept) of each row; ``id`` is the text's key where the row has none."""
    node = F.coalesce(F.col(doc_id), _unnamed(doc_id, text, df))
    documents = df.select(node.alias("id"), F.col(text).alias("text"), F.col(doc_id).isNull().alias("unnamed"))
    slim = step(sketches(documents, words))
    classes = step(slim.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    firsts = classes.select("digest", F.col("rep").alias("id"))
    reps = slim.join(firsts, ["digest", "id"]).groupBy("id").agg(F.max("n_shingles").alias("n"), F.max_by("sketch", "digest").alias("sketch"))
    reps = step(reps)

    p, q = similarity.numerator, similarity.denominator
    exact = lambda n: -F.floor(-(n * p) / q)
    fits = math.floor(float(similarity) * SKETCH)
    must = F.when(F.col("n") <= fits, exact(F.col("n"))).otherwise(F.least(F.lit(least_shared(similarity)), exact(F.col("n"))))
    postings = reps.select(F.explode("sketch").alias("value"), "id", "n", F.size("sketch").alias("retained"))
    listed = _lists(postings, F.col("retained") - must + 1)
    short = listed.where(F.col("length") <= LONG)
    hot = step(listed.where(F.col("length") > LONG).select("id").distinct())
    sets = step(full_sets(documents, hot, words))
    wholes = sets.select(F.explode("whole").alias("value"), "id", F.size("whole").cast("long").alias("n"), F.size("whole").alias("retained"))
    again = _lists(wholes, F.col("n") - exact(F.col("n")) + 1)
    lists = short.unionByName(again)
    release(hot, sets)

    size = reps.select(F.col("id").alias("first"), F.col("n").alias("m"))
    stars = lists.where("id <> first").select("first", "id", "n").distinct().join(size, "first").where(_fits("n", "m", similarity))
    links = _verified(stars.select(F.col("first").alias("a"), F.col("id").alias("b")), reps, documents, words, similarity)
    grown = components(links)
    more = _between(lists, grown, reps, documents, words, similarity)
    # What has grown together already takes part as stars, so that few rounds are left.
    final = components(grown.toDF("a", "b").union(more))

    placed = step(classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("digest", "copies", F.coalesce("component", "rep").alias("component")))
    release(classes, reps, listed, again, links, grown, more, final)
    result = join_counted(slim, placed, "digest", "copies", "left").withColumn("component", F.coalesce("component", "id"))
    # A component that only rows without an id belong to has no id to be named by.
    unnamed = F.col("component") > F.lit(chr(0x10FFFF) if isinstance(df.schema[doc_id].dataType, StringType) else (1 << 63) - 1 - (1 << 60))
    return result.select("id", "unnamed", "n_shingles", F.when(~unnamed, F.col("component")).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def groups(df: DataFrame, words: int = 5, similarity: Fraction = Fraction(8, 10), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``n_shingles``, ``component_id`` and ``kept`` (the row of the component's smallest id)."""
    others = [x for x in df.columns if x not in ("n_shingles", "component_id", "kept")]
    # Rows of one id count as one document, whatever their texts are.
    one = members(df, words, similarity, doc_id, text).groupBy("id").agg(F.min("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"), F.min("kept").alias("kept"))
    node = F.coalesce(F.col(doc_id), _unnamed(doc_id, text, df))
    return df.select(*others, node.alias("_node")).join(one, F.col("_node") == one["id"], "left").select(*others, "n_shingles", "component_id", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = members(documents, words=3, similarity=Fraction(85, 100))
    return found.select(F.when(~F.col("unnamed"), F.col("id")).alias("doc_id"), "n_shingles", "component_id", "kept")


#: All pairs of documents that share a shingle, counted, and the closure of the links.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + 2], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM words UNION SELECT id, b FROM reach JOIN both_ways ON a = other)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT id AS doc_id, min(other) AS component_id FROM reach GROUP BY id) LEFT JOIN sizes USING (doc_id)
"""

"""Helpers that several of the training-data operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbra.llm.text_hashes import give_back
from umbra.plans.storage import cut as cut

#: Bytes of the texts of one class that a model learns from at most.
SAMPLE_BYTES = 8 << 20
#: A key of more than this part of the rows is hot, so there are at most as many hot keys.
HOT = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_counted(left: DataFrame, counted: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``counted``, which has one row a key and says how many rows of ``left`` have it.

    Keys with more than one in ``HOT`` of the rows, of which there are at most ``HOT``, are broadcast, so that a hot key's
    rows stay where they are; the others are shuffled. ``how`` is inner, or left if ``counted`` has all keys but null.
    """
    rows, most = counted.agg(F.sum(count), F.max(count)).first()
    if not rows or most <= max(rows // HOT, 1):
        return left.join(counted, key, how)
    hot = F.col(count) > max(rows // HOT, 1)
    named = F.broadcast(counted.where(hot).select(F.col(key).alias("_hot")))
    many = left.join(F.broadcast(counted.where(hot)), key)
    few = left.join(named, left[key] == named["_hot"], "left_anti").join(counted.where(~hot), key, how)
    return many.unionByName(few.select(many.columns))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows a few hundred at a time, so that a worker holds what it makes of these only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample_of_labels(documents: DataFrame, labels: DataFrame, label: str, per_class: int, classes: int = 2, bytes_a_class: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label): at most ``per_class`` labelled documents of each class, chosen by a hash of the id.

    Of these the first are taken whose whole texts have ``bytes_a_class`` bytes in all, but the first in any case. Only
    labels outside the held-out fifth count. A document with contradicting labels takes the largest, one with several
    texts the smallest of them. The bounds make what is learnt from independent of the size of the corpus. Rows without
    id, text or label take no part.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").between(0, classes - 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in range(classes)]
    chosen = parts[0]
    for more in parts[1:]:
        chosen = chosen.unionByName(more)
    # At most classes * per_class pairs of two numbers, so the broadcast is bounded.
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    ahead = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = found.withColumn("_sum", F.sum(F.octet_length("text").cast("long")).over(ahead)).withColumn("_k", F.count("*").over(ahead))
    return sized.where((F.col("_sum") <= bytes_a_class) | (F.col("_k") == 1)).select("doc_id", "text", "label")


def learnt(sample: DataFrame, train: Callable[[list[tuple[int, str]]], dict[str, bytes]]) -> dict[str, bytes]:
    """What ``train`` makes of a bounded sample's (label, text) pairs, in one task; the driver gets the model only.

    The pairs come in the order of ``doc_id``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "label", "text")), strict=True)]
        rows.sort(key=lambda r: r[0])
        made = train([r[1:] for r in rows])
        rows.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(made.keys(), pa.string()), pa.array(made.values(), pa.binary())], ["name", "value"])

    return {r.name: bytes(r.value) for r in sample.select("doc_id", "label", "text").repartition(1).mapInArrow(work, "name string, value binary").collect()}

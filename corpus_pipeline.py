"""A training-data pipeline over ``documents``: each stage filters or codes what the one before it has kept.

``run`` writes every stage's result as Parquet under the shared checkpoint folder and reads it again for the next one,
so that a lost executor costs one stage's tasks at most. A stage's result is deleted when the next one has been written;
that of the last but one stays, as the rows that ``run`` returns are read from it.

Defined cases: documents without an id are judged by their texts like all others, and of those with one text one row
stays; rows of one id count as one document for near copies and are kept or dropped together there; null and empty
texts get the score of a text without words in the first two stages, are no copies of each other, hold no benchmark
item and have no tokens; extra columns stay up to the last stage; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import op2_byte_bpe, op3_toxicity, op4_near_dedup, op5_decontamination, op7_quality
from umbra.llm.common import table
from umbra.plans.storage import shared_folder, tidy


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade of 1 or more is at least a half."""
    model = op7_quality.fit(docs, table(spark, sf_dir, "labels"))
    return op7_quality.grade(docs, model).where("kept").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below a half."""
    model = op3_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return op3_toxicity.score(docs, model).where("score < 0.5").select(docs.columns)


@tidy
def _kept(docs: DataFrame) -> DataFrame:
    """The kept rows, written; the sketches and classes that they follow from are deleted then."""
    return op4_near_dedup.groups(docs, words=5, similarity=Fraction(8, 10)).where("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    kept = _kept(docs)
    # Without an id, rows of one text can't be told apart, so all are kept or none; here one of them is.
    return kept.where("doc_id IS NOT NULL").unionByName(kept.where("doc_id IS NULL").dropDuplicates(["text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, with its own or with other numbers, units and names."""
    return op5_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives the text's bytes again."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = op2_byte_bpe.round_trip(docs.select("doc_id", "text"), path, pattern)
    return coded.select(
        "doc_id",
        (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        "ids_le",
        F.sha2("ids_le", 256).alias("ids_sha256"),
        (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("restored"),
    )


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]
#: Learnt models, components and token ids have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


def _delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through Spark's own file systems, so wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

import glob
import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from umbra.llm import graph
from umbra.llm import op4_near_dedup as op
from umbra.plans import storage


def written(spark):
    storage.shared_folder(spark)
    return set(glob.glob(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:") + "/rdd-*"))


def shuffled(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {x for x in held.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}


def soon_no_more_than(spark, before):
    for _ in range(100):  # Spark deletes them in the background
        if shuffled(spark) <= before:
            return True
        time.sleep(0.1)
    return False


def test_near_copies_leave_what_their_rows_are_read_from(spark):
    docs = spark.createDataFrame([(k, f"a b c d e {k % 7} f g h {k % 5}") for k in range(200)], "doc_id long, text string").repartition(3)
    before = written(spark)
    found = op.members(docs, 3)
    assert len(written(spark) - before) == 2
    assert [found.where("kept").count(), found.count()] == [7 * 5, 200]


def test_the_near_copy_stage_leaves_its_kept_rows_only(spark):
    docs = spark.createDataFrame([(k, f"a b c d e {k % 7} f g h {k % 5}") for k in range(200)] + [(None, "x y z"), (None, "x y z")], "doc_id long, text string").repartition(3)
    before = written(spark)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert len(written(spark) - before) == 1
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, *range(35)]


def test_components_read_their_edges_once_a_pass(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "step", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or storage.step(df))
    found = graph.components(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long"))
    assert len(plans) > 1 and not any("Union" in x for x in plans)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)]


def test_a_step_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    assert len(storage.step(spark.range(1000).selectExpr("id % 100 AS k").groupBy("k").count()).collect()) == 100
    assert soon_no_more_than(spark, before)


def test_steps_end_with_their_scope(spark):
    @storage.tidy
    def inner(df):
        return storage.step(df.groupBy("k").count()).withColumn("twice", F.col("count") * 2)

    @storage.tidy
    def outer(df):
        return inner(df).join(inner(df).select("k", F.col("twice").alias("more")), "k")

    @storage.tidy
    def failing(df):
        storage.step(df)
        raise ValueError("no")

    df, before = spark.range(100).selectExpr("id % 4 AS k"), written(spark)
    made = outer(df)
    assert len(written(spark) - before) == 1
    assert sorted(map(tuple, made.collect())) == [(k, 25, 50, 50) for k in range(4)]
    with pytest.raises(ValueError):
        failing(df)
    assert len(written(spark) - before) == 1 and storage._scopes() == [] and spark.conf.get(storage._FREE) == "false"
    storage.release(made)
    assert written(spark) == before

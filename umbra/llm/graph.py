"""Connected components of a link table, by joins and pre-aggregated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.plans.storage import step, tidy

MAX_ROUNDS = 60


def _each(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v): each row's values of these pairs of columns, from one pass; a union would run all tasks once for each pair."""
    return df.select(F.explode(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs))).alias("e")).select("e.*")


@tidy
def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b); the component is its smallest node.

    Every round hangs each node's larger neighbours on its smallest one, then does the same for the smaller ones, until
    nothing changes: stars remain. A hub's neighbours are joined to one row of the hub, which Spark can split.
    """
    edges = step(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = _each(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _each(large.join(lowest, "u"), ("u", "m"), ("v", "m"))
        edges = step(small.where("u <> v").distinct())
    else:
        raise RuntimeError("the components did not settle")
    return _each(edges, ("u", "v"), ("v", "v")).distinct().toDF("id", "component")

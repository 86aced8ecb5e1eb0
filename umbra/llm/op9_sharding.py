"""Sharding by balanced label propagation, in DataFrame functions only.

Documents are nodes; documents with equal texts are linked, not by all pairs but as stars: a group is cut into blocks of
bounded size, every member is linked with its block's hub, and the hubs of a group form a chain. Labels, at first by a
hash, are shard numbers. In turn members and hubs ask for the shard in which most of their neighbours are. A move from
shard a to b is granted as far as moves from b to a and the room that linked rows leave in b allow; a hash decides whose. The
shard-to-shard counts are the only thing that the driver sees (shards squared).

At the end the law ``rows`` is met exactly: shard sizes differ by one row at most. Rows are ranked within each shard in
buckets of bounded size, linked ones first, so that the rows beyond a shard's quota are unlinked ones as long as there
are any; these fill the shards that lack rows. Slots are gapless from 0.

Defined cases: null and empty texts have size 1, checksum 0 and are equal; a missing id is a node of its own text;
repeated rows are one node but are counted, placed and returned as rows; an empty table gives no rows. Extra columns
play no part.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbra.llm.common import cut, join_counted, table

SHARDS, ROUNDS = 8, 4
#: Blocks that a shard's share of rows is at least worth, so that what is kept together fits beside other rows.
BLOCKS_A_SHARD = 8
#: Rows of a bucket within which rows are ranked, about.
BUCKET_ROWS = 5_000
_SCALE = 1 << 20


def _cases(values: list[int], at: Column) -> Column:
    """The number in ``values`` (one a shard) at a column's place."""
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), at + 1)


def _chance(node: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(salt)), F.lit(_SCALE))


def links(base: DataFrame, rows: int, shards: int) -> DataFrame:
    """(a, b): members with their block's hub, hubs with the next block's hub. ``base``: (node, text_key)."""
    most = max(1, rows // (shards * BLOCKS_A_SHARD))
    many = cut(base.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1"))
    members = join_counted(base, many, "text_key", "n").select("node", F.struct("text_key", F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("n") / most)).alias("block")).alias("place"))
    members = cut(members.distinct())
    held = cut(members.groupBy("place").agg(F.min("node").alias("hub"), F.count("*").alias("held")))
    inside = join_counted(members, held, "place", "held").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    hubs = held.select("place.text_key", "place.block", "hub")
    after = hubs.select("text_key", (F.col("block") - 1).alias("block"), F.col("hub").alias("next"))
    chain = hubs.join(after, ["text_key", "block"]).select(F.col("hub").alias("a"), F.col("next").alias("b"))
    return inside.withColumn("chain", F.lit(False)).union(chain.withColumn("chain", F.lit(True)))


def propagate(edges: DataFrame, rows: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, label) of all linked nodes."""
    both = cut(edges.select("a", "b", F.lit(False).alias("hub")).union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("hub"))))
    nodes = both.groupBy(F.col("a").alias("node")).agg(F.max("hub").alias("hub"))
    labels = cut(nodes.withColumn("label", F.pmod(F.xxhash64("node", F.lit(11)), F.lit(shards)).cast("int")))
    for turn in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a", "label").agg(F.count("*").alias("n"))
        tally = seen.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("seen"), F.max_by("label", F.struct("n", -F.col("label"))).alias("wish"))
        wishes = labels.join(tally, labels.node == tally.a)
        gain = F.element_at("seen", F.col("wish")) - F.coalesce(F.try_element_at("seen", F.col("label")), F.lit(0))
        asks = F.when((gain > 0) & (F.col("hub") == F.lit(turn % 2 == 0)), F.col("wish")).otherwise(F.col("label"))
        wishes = cut(wishes.select("node", "hub", "label", asks.alias("wish")))
        flow = {(r.label, r.wish): r.n for r in wishes.groupBy("label", "wish").agg(F.count("*").alias("n")).collect()}  # shards squared
        size = [sum(n for (a, _), n in flow.items() if a == s) for s in range(shards)]
        granted = []
        for a in range(shards):
            for b in range(shards):
                asked = flow.get((a, b), 0)
                room = max(0, rows // shards - size[b]) // max(1, shards - 1)
                granted.append(_SCALE if a == b or not asked else _SCALE * min(asked, flow.get((b, a), 0) + room) // asked)
        allowed = _chance("node", 100 + turn) < _cases(granted, F.col("label") * shards + F.col("wish"))
        labels = cut(wishes.select("node", "hub", F.when(allowed, F.col("wish")).otherwise(F.col("label")).alias("label")))
    return labels.select("node", "label")


def assign(df: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.xxhash64(whole).alias("h"))
    base = base.select("doc_id", "size", "text_crc32", F.xxhash64("h", "text_crc32", "size").alias("text_key"))
    base = cut(base.withColumn("node", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text_key")))
    rows = base.count()
    labels = propagate(links(base.select("node", "text_key"), rows, shards), rows, shards)

    placed = base.join(labels, "node", "left").withColumn("free", F.col("label").isNull().cast("int"))
    placed = placed.withColumn("label", F.coalesce("label", F.pmod(F.xxhash64("node", F.lit(13)), F.lit(shards)).cast("int")))
    buckets = max(1, -(-rows // (shards * BUCKET_ROWS)))
    placed = cut(placed.withColumn("bucket", F.pmod(F.xxhash64("node", "doc_id", F.lit(17)), F.lit(buckets)).cast("int")))
    bucket = ["label", "free", "bucket"]
    counts = placed.groupBy(*bucket).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("label").orderBy("free", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select(*bucket, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), "n"))
    held = {r.label: r.n for r in offsets.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one row a shard

    have = [held.get(s, 0) for s in range(shards)]
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    over = [max(0, h - q) for h, q in zip(have, quota, strict=True)]
    under = [max(0, q - h) for h, q in zip(have, quota, strict=True)]
    over_at, under_at = ([0, *accumulate(x)] for x in (over, under))
    within = Window.partitionBy(*bucket).orderBy("text_key", "node", "doc_id")
    ranked = placed.withColumn("k", F.row_number().over(within)).join(offsets.select(*bucket, "ahead"), bucket).withColumn("rank", F.col("ahead") + F.col("k") - 1)
    extra = _cases(over_at, F.col("label")) + F.col("rank") - _cases(quota, F.col("label"))
    ranked = ranked.withColumn("extra", F.when(F.col("rank") >= _cases(quota, F.col("label")), extra))
    to = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in under_at[1:])), lambda end: end <= F.col("extra")))
    ranked = ranked.withColumn("shard", F.when(F.col("extra").isNull(), F.col("label")).otherwise(to).cast("int"))
    slot = F.when(F.col("extra").isNull(), F.col("rank")).otherwise(_cases(have, F.col("shard")) + F.col("extra") - _cases(under_at, F.col("shard")))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"))

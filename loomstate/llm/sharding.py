"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Each key hashes to one of 65,536 ring cells and belongs to the next virtual node clockwise. A shard's bound is
shared among its virtual nodes in proportion to their loads; the keys that a virtual node can't hold, the last of
its arc, continue clockwise to the first that has room, in the order in which they meet it. With slack 0 the bounds
are n / shards rounded down or up, so that counts differ by one at most (the law `rows`); only what exceeds a
shard's bound leaves its home, the fewest that any balance allows.

All decisions follow from the counts of the virtual nodes, a table bounded by shards * virtual nodes; rows shuffle
once, by virtual node. Defined results: a null text has no bytes, crc32 0; a null id hashes as empty text;
repeated rows each take a slot of their own, and equal texts aren't kept together; keys that hash alike go by their
identifiers; texts of any length only count; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, text_column
from .sql import CRC_TABLE_SQL, crc32_sql, md5_bits_sql

SHARDS, VNODES, CELLS = 40, 128, 65536


def ring_hash(of):
    """The first 32 bits of md5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(of.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """vnode (in ring order), shard, first and last cell of its arc. Of virtual nodes on the same cell the lowest shard has it."""
    at = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("v"))
        .withColumn("cell", F.floor(ring_hash(F.concat_ws(":", F.lit("shard"), "shard", "v")) / (2**32 // CELLS)))
        .groupBy("cell").agg(F.min("shard").alias("shard"))
    )
    order = Window.orderBy("cell")
    return at.select(
        (F.row_number().over(order) - 1).cast("long").alias("vnode"), "shard", F.lag("cell", 1, -1).over(order).alias("after"), F.col("cell").alias("last"),
        F.max("cell").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top"),
    )


def arcs(nodes: DataFrame) -> DataFrame:
    """Each ring cell's virtual node; the cells beyond the last belong to the first."""
    own = nodes.select("vnode", F.explode(F.sequence(F.col("after") + 1, F.col("last"))).alias("cell"))
    rest = nodes.where("vnode = 0").select("vnode", F.explode(F.expr(f"if(top < {CELLS - 1}, sequence(top + 1, {CELLS - 1}L), array())")).alias("cell"))
    return own.union(rest)


def bounded(nodes: DataFrame, loads: DataFrame, shards: int, slack: float) -> DataFrame:
    """vnode, segs: for the ranks of its keys, which shard takes them and in which slots."""
    of_shard, clockwise = Window.partitionBy("shard"), Window.orderBy("vnode")
    everything = Window.partitionBy()
    loaded = nodes.join(loads, "vnode", "left").select("vnode", "shard", F.coalesce("load", F.lit(0)).cast("long").alias("load"))
    total = loaded.withColumn("n", F.sum("load").over(everything))
    bound = F.expr(f"n div {shards} + if(shard < n % {shards}, 1, 0)") if slack == 0 else F.ceil((1 + F.lit(slack)) * F.col("n") / shards)
    quota = total.withColumn("bound", bound.cast("long")).withColumn("w", F.when(F.sum("load").over(of_shard) > 0, F.col("load")).otherwise(1))
    part = quota.withColumn("share", F.expr("cast(bound as decimal(19,0)) * cast(w as decimal(19,0))")).withColumn("all_w", F.sum("w").over(of_shard))
    floor = part.withColumn("cap", F.expr("cast(share div all_w as bigint)")).withColumn("frac", F.expr("share % all_w"))
    extra = F.row_number().over(of_shard.orderBy(F.desc("frac"), "vnode")) <= F.col("bound") - F.sum("cap").over(of_shard)
    capped = floor.withColumn("extra", extra).withColumn("cap", F.expr("cap + if(extra, 1, 0)"))
    # What passes each node clockwise: twice round the ring, of which the second round is the steady state.
    laps = capped.select("vnode", "shard", "load", "cap", F.explode(F.array(F.lit(0), F.lit(1))).alias("lap"))
    run = Window.orderBy("lap", "vnode").rowsBetween(Window.unboundedPreceding, 0)
    passed = laps.withColumn("p", F.sum(F.col("load") - F.col("cap")).over(run)).withColumn("carry", F.col("p") - F.least(F.lit(0), F.min("p").over(run)))
    before = passed.withColumn("come", F.lag("carry", 1, 0).over(Window.orderBy("lap", "vnode"))).where("lap = 1")
    flow = before.withColumn("kept", F.least("load", "cap")).withColumn("sent", F.expr("load - kept")).withColumn("taken", F.expr("least(cap, load + come) - kept"))
    # Starting behind a node that nothing passes, the k-th key sent on takes the k-th place that is taken.
    start = flow.withColumn("zero", F.min(F.when(F.col("carry") == 0, F.col("vnode"))).over(everything)).withColumn("turn", (F.col("vnode") <= F.col("zero")).cast("int"))
    prior, slots = Window.orderBy("turn", "vnode").rowsBetween(Window.unboundedPreceding, -1), of_shard.orderBy("vnode").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    plan = start.select(
        "vnode", "shard", "kept", "sent", "taken", zero(F.sum("sent").over(prior)).alias("sent_at"), zero(F.sum("taken").over(prior)).alias("taken_at"),
        zero(F.sum(F.col("kept") + F.col("taken")).over(slots)).alias("slot"),
    )
    marks = plan.where("sent > 0").select(F.col("sent_at").alias("at"), F.struct("vnode", "kept", "sent_at").alias("src"), F.lit(None).cast("struct<shard:bigint,slot:bigint,taken_at:bigint>").alias("dst"))
    marks = marks.union(plan.where("taken > 0").select("taken_at", F.lit(None).cast("struct<vnode:bigint,kept:bigint,sent_at:bigint>"), F.struct("shard", F.expr("slot + kept"), "taken_at")))
    merged = marks.groupBy("at").agg(F.max("src").alias("src"), F.max("dst").alias("dst"))
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    pieces = merged.select("at", F.last("src", True).over(upto).alias("src"), F.last("dst", True).over(upto).alias("dst"), F.lead("at").over(Window.orderBy("at")).alias("until"))
    moved = pieces.select(
        F.col("src.vnode").alias("vnode"), F.expr("src.kept + at - src.sent_at").alias("lo"), F.expr("src.kept + coalesce(until, 9223372036854775807 - src.kept) - src.sent_at").alias("hi"),
        F.col("dst.shard").alias("shard"), F.expr("dst.slot + at - dst.taken_at").alias("slot"),
    )
    home = plan.select("vnode", F.lit(0).cast("long").alias("lo"), F.col("kept").alias("hi"), "shard", "slot")
    return home.union(moved).groupBy("vnode").agg(F.collect_list(F.struct("lo", "hi", "shard", "slot")).alias("segs"))


def shard_rows(docs: DataFrame, columns: list, id_col: str = "doc_id", shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """The columns of each row of docs, with shard and slot. The broadcast tables have 65,536 and shards * vnodes rows at most."""
    spark = docs.sparkSession
    nodes = ring(spark, shards, vnodes)
    cell = (F.col("_h") / (2**32 // CELLS)).cast("long")
    loads = docs.select(ring_hash(F.col(id_col)).alias("_h")).groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).join(F.broadcast(arcs(nodes)), "cell").groupBy("vnode").agg(F.sum("n").alias("load"))
    segs = bounded(nodes, loads, shards, slack)
    rows = docs.select(F.struct(*columns).alias("_row"), ring_hash(F.col(id_col)).alias("_h"), F.col(id_col).alias("_id"))
    placed = rows.withColumn("cell", cell).join(F.broadcast(arcs(nodes)), "cell")
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("vnode").orderBy("_h", "_id")) - 1)
    seg = F.expr("filter(segs, s -> s.lo <= _r and _r < s.hi)[0]")
    return ranked.join(F.broadcast(segs), "vnode").withColumn("_s", seg).select("_row.*", F.col("_s.shard").cast("int").alias("shard"), F.expr("_s.slot + _r - _s.lo").cast("long").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size")
    crc = F.crc32(text_column().cast("binary")).alias("text_crc32")
    found = shard_rows(docs, ["doc_id", size, crc])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


CLOCKWISE = "OVER (ORDER BY lap, vnode ROWS UNBOUNDED PRECEDING)"
OP5_SQL = f"""WITH {CRC_TABLE_SQL},
spots AS (SELECT {md5_bits_sql("'shard:' || s || ':' || v", 8)} // {2**32 // CELLS} AS cell, min(s) AS shard FROM range({SHARDS}) a(s), range({VNODES}) b(v) GROUP BY 1),
nodes AS (SELECT row_number() OVER (ORDER BY cell) - 1 AS vnode, shard, lag(cell, 1, -1) OVER (ORDER BY cell) AS behind, cell FROM spots),
hashed AS (SELECT doc_id, coalesce(text, '') AS text, {md5_bits_sql("coalesce(CAST(doc_id AS VARCHAR), '')", 8)} AS h FROM documents),
homes AS (SELECT d.*, coalesce(n.vnode, 0) AS vnode FROM hashed d LEFT JOIN nodes n ON d.h // {2**32 // CELLS} > n.behind AND d.h // {2**32 // CELLS} <= n.cell),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vnode ORDER BY h, doc_id) - 1 AS r FROM homes),
loaded AS (SELECT n.vnode, n.shard, count(r.vnode) AS load FROM nodes n LEFT JOIN ranked r USING (vnode) GROUP BY ALL),
bounds AS (SELECT *, sum(load) OVER () // {SHARDS} + CASE WHEN shard < sum(load) OVER () % {SHARDS} THEN 1 ELSE 0 END AS bound, CASE WHEN sum(load) OVER (PARTITION BY shard) > 0 THEN load ELSE 1 END AS w FROM loaded),
parts AS (SELECT *, bound * w // sum(w) OVER (PARTITION BY shard) AS least_cap, bound * w % sum(w) OVER (PARTITION BY shard) AS frac FROM bounds),
capped AS (SELECT vnode, shard, load, least_cap + CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY frac DESC, vnode) <= bound - sum(least_cap) OVER (PARTITION BY shard) THEN 1 ELSE 0 END AS cap FROM parts),
laps AS (SELECT c.*, lap, sum(load - cap) {CLOCKWISE} AS p FROM capped c, range(2) l(lap)),
carried AS (SELECT *, p - least(0, min(p) {CLOCKWISE}) AS carry FROM laps),
flow AS (SELECT *, lag(carry, 1, 0) OVER (ORDER BY lap, vnode) AS come, least(load, cap) AS kept FROM carried QUALIFY lap = 1),
zeroed AS (SELECT *, load - kept AS sent, least(cap, load + come) - kept AS taken, CASE WHEN vnode <= min(CASE WHEN carry = 0 THEN vnode END) OVER () THEN 1 ELSE 0 END AS turn FROM flow),
places AS (SELECT *, sum(sent) OVER (ORDER BY turn, vnode) - sent AS sent_at, sum(taken) OVER (ORDER BY turn, vnode) - taken AS taken_at, sum(kept + taken) OVER (PARTITION BY shard ORDER BY vnode) - kept - taken AS slot_at FROM zeroed),
rows_at AS (SELECT r.*, p.kept, p.shard, p.slot_at, CASE WHEN r >= p.kept THEN p.sent_at + r - p.kept END AS moved FROM ranked r JOIN places p USING (vnode))
SELECT a.doc_id, CAST(strlen(a.text) + 16 AS BIGINT) AS size, {crc32_sql("a.text")} AS text_crc32, 'rows' AS law, CAST(coalesce(t.shard, a.shard) AS INTEGER) AS shard,
  CAST(CASE WHEN moved IS NULL THEN a.slot_at + a.r ELSE t.slot_at + t.kept + moved - t.taken_at END AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM rows_at a LEFT JOIN places t ON a.moved >= t.taken_at AND a.moved < t.taken_at + t.taken CROSS JOIN crc"""

"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

A token budget goes down the tree domain - language - source. At each node the children share by their weights, none
gets more than it can give (its tokens times the epochs allowed), and what one can't use goes to its siblings in
proportion; as a node never gets more than its children can give together, a shortage is met by siblings first and
reaches the ancestors only when a whole subtree is used up. Each leaf then gives whole epochs, and of the next one the
prefix, in an order seeded by epoch, whose tokens fit its budget.

The prefix is found by hashed ranges: tokens are summed by leaf and range, a bounded table, and added up by 64 wide ranges
first and inside these then, so that a task orders 64 rows of a leaf at most; only the range in which
a leaf's budget ends is ordered by row, and gives the leaf's threshold; the rows themselves are only filtered.

Defined results: null domain, language or source count as empty text; null or empty texts have one token; a null
identifier is hashed as empty text; rows that tie in hash and identifier go in or stay out together; a text counts by its
whole length; other columns, whatever their names, stay as they are; an empty table gives no rows. Unnamed children have weight 1; weights must be above 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, read_table, stored
from .sql import CRC_TABLE_SQL, crc32_sql, md5_bits_sql

#: Production weights (of sources none, so that those of a domain and language count alike); the share of all tokens that the mix has; epochs that a leaf may give; the order's seed.
DOMAIN_WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}
LANG_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}
SOURCE_WEIGHTS: dict[str, float] = {}
SHARE, EPOCHS, SEED = 0.8, 2, 7
#: Hashed ranges of a leaf; leaves that are broadcast at most.
RANGES, BROADCAST_LEAVES = 4096, 200_000
LEAF = ["_domain", "_lang", "_source"]


def domain_of(source: str = "source") -> Column:
    """Documents have no domain; their sources are dealt to four by crc32."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce(F.col(source), F.lit("")).cast("binary")), F.lit(4)).cast("string"))


def tokens_of(text: str = "text") -> Column:
    """A token for every four bytes begun, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4)).cast("long")


def weight(column: str, weights: dict[str, float]) -> Column:
    if min(weights.values(), default=1) <= 0:
        raise ValueError("weights must be above 0")
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col(column)], F.lit(1.0))


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent columns, name, w, cap, budget of the parent) with got: budget shared by w, no more than cap."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = nodes.withColumn("level", (F.col("budget") - before) / rest).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    top = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent))
    return level.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(top * F.col("w"))).drop("level", "full")


def ordering(epoch: Column, seed: int) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def plan(leaves: DataFrame, share: float, epochs: int, domain_weights: dict, lang_weights: dict, source_weights: dict = SOURCE_WEIGHTS) -> DataFrame:
    """A row for each leaf: full (epochs given whole) and rest (tokens of the next)."""
    caps = leaves.withColumn("cap", (F.col("held") * epochs).cast("double"))
    whole = leaves.agg(F.floor(F.sum("held") * share).cast("double").alias("budget"))
    d = caps.groupBy("_domain").agg(F.sum("cap").alias("cap")).withColumn("w", weight("_domain", domain_weights)).join(F.broadcast(whole))
    d = share_out(d, [], "_domain").select("_domain", F.col("got").alias("budget"))
    n = caps.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap")).withColumn("w", weight("_lang", lang_weights)).join(d, "_domain")
    n = share_out(n, ["_domain"], "_lang").select("_domain", "_lang", F.col("got").alias("budget"))
    s = share_out(caps.withColumn("w", weight("_source", source_weights)).join(n, ["_domain", "_lang"]), ["_domain", "_lang"], "_source")
    quota = s.withColumn("quota", F.floor(F.col("got") + 1e-6).cast("long"))
    full = quota.withColumn("full", F.least(F.expr("quota div held"), F.lit(epochs)))
    return full.select(*LEAF, "held", "quota", "full", (F.col("quota") - F.col("full") * F.col("held")).alias("rest"))


def mix(docs: DataFrame, columns: list, domain: Column, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS, tokens: Column | None = None, source_weights=SOURCE_WEIGHTS) -> DataFrame:
    """The columns of each row that the mix has, once for each epoch, with epoch (from 0)."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    tokens = tokens_of() if tokens is None else tokens
    base = docs.select(F.struct(*columns).alias("_row"), name(domain).alias("_domain"), name(F.col("lang")).alias("_lang"), name(F.col("source")).alias("_source"), F.col("doc_id").alias("_id"), tokens.alias("_t"))
    slim = stored(base.select(*LEAF, "_id", "_t"), "slim")
    leaves = stored(plan(slim.groupBy(*LEAF).agg(F.sum("_t").alias("held")), share, epochs, domain_weights, lang_weights, source_weights), "leaves")
    few = leaves.count() <= BROADCAST_LEAVES
    small = F.broadcast if few else lambda x: x
    hashed = slim.join(small(leaves), LEAF).where("rest > 0").withColumn("_h", ordering(F.col("full"), seed)).withColumn("_range", F.shiftright("_h", 48))
    sums = hashed.groupBy(*LEAF, "rest", "_range").agg(F.sum("_t").alias("t")).withColumn("_wide", F.shiftright("_range", 6))
    sums = stored(sums, "sums")
    wide = sums.groupBy(*LEAF, "_wide").agg(F.sum("t").alias("s"))
    wide = wide.select(*LEAF, "_wide", (F.sum("s").over(Window.partitionBy(*LEAF).orderBy("_wide")) - F.col("s")).alias("ahead"))
    upto = F.col("ahead") + F.sum("t").over(Window.partitionBy(*LEAF, "_wide").orderBy("_range"))
    ends = sums.join(wide, [*LEAF, "_wide"]).withColumn("upto", upto).where("upto > rest").groupBy(*LEAF).agg(F.min(F.struct("_range", (F.col("upto") - F.col("t")).alias("before"))).alias("e"))
    ends = stored(ends.select(*LEAF, F.col("e._range").alias("_end"), F.col("e.before").alias("before")), "ends")
    edge = hashed.join(small(ends), LEAF).where("_range = _end")
    reach = F.col("before") + F.sum("_t").over(Window.partitionBy(*LEAF).orderBy("_h", "_id"))
    last = edge.withColumn("reach", reach).where("reach <= rest").groupBy(*LEAF).agg(F.max(F.struct("_h", "_id")).alias("_last"))
    cut = stored(leaves.select(*LEAF, "full", "rest").join(small(ends.select(*LEAF, "_end")), LEAF, "left").join(small(last), LEAF, "left"), "cut")
    rows = base.join(small(cut), LEAF).withColumn("_h", ordering(F.col("full"), seed))
    inside = F.expr("rest > 0 and (_end is null or _h < shiftleft(_end, 48) or (_last is not null and (_h < _last._h or (_h = _last._h and (_id is null or _id <= _last._id)))))")
    copies = rows.withColumn("_n", F.col("full") + F.when(inside, 1).otherwise(0)).where("_n > 0")
    return copies.select("_row", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("epoch")).select("_row.*", "epoch")


def keep_mix(docs: DataFrame, share: float = 0.9, source_weights: dict = SOURCE_WEIGHTS) -> DataFrame:
    """The rows of docs that a mix of one epoch has."""
    wrapped = docs.select("doc_id", "text", "lang", "source", F.struct(*columns_of(docs)).alias("_all"))
    return mix(wrapped, ["_all"], domain_of(), share=share, epochs=1, source_weights=source_weights).select("_all.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mix(docs, ["doc_id", domain_of().alias("domain"), "lang", "source", tokens_of().alias("tokens")], domain_of())


def _weight_sql(column: str, weights: dict[str, float]) -> str:
    return f"CAST(CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END AS DOUBLE)"


def _shared_sql(name: str, nodes: str, parent: str, child: str) -> str:
    """A common table of that name: nodes (parent, child, w, cap, budget) with got, as share_out has it."""
    by = f"PARTITION BY {parent} " if parent else ""
    order = f"{by}ORDER BY cap / w, {child}"
    return f"""{name}_level AS (SELECT *, (budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {nodes}),
{name} AS (SELECT *, CASE WHEN cap <= level * w THEN cap ELSE w * max(CASE WHEN cap > level * w THEN level END) OVER ({by}) END AS got FROM {name}_level)"""


OP9_SQL = f"""WITH {CRC_TABLE_SQL},
sources AS (SELECT s, 'd' || ({crc32_sql("s")} % 4) AS domain FROM (SELECT DISTINCT coalesce(source, '') AS s FROM documents), crc),
docs AS (SELECT doc_id, domain, coalesce(lang, '') AS l, s, lang, source, greatest(1, (coalesce(strlen(text), 0) + 3) // 4) AS tokens FROM documents JOIN sources ON s = coalesce(source, '')),
leaves AS (SELECT domain, l, s, sum(tokens) AS held, CAST(sum(tokens) * {EPOCHS} AS DOUBLE) AS cap FROM docs GROUP BY ALL),
d_nodes AS (SELECT domain, sum(cap) AS cap, {_weight_sql("domain", DOMAIN_WEIGHTS)} AS w, (SELECT floor(CAST(sum(held) AS DOUBLE) * CAST({SHARE} AS DOUBLE)) FROM leaves) AS budget FROM leaves GROUP BY domain),
{_shared_sql("d", "d_nodes", "", "domain")},
l_nodes AS (SELECT v.domain, l, sum(v.cap) AS cap, {_weight_sql("l", LANG_WEIGHTS)} AS w, max(d.got) AS budget FROM leaves v JOIN d USING (domain) GROUP BY v.domain, l),
{_shared_sql("m", "l_nodes", "domain", "l")},
s_nodes AS (SELECT v.domain, v.l, s, held, v.cap, CAST(1 AS DOUBLE) AS w, m.got AS budget FROM leaves v JOIN m USING (domain, l)),
{_shared_sql("n", "s_nodes", "domain, l", "s")},
quotas AS (SELECT domain, l, s, held, CAST(floor(got + CAST(1e-6 AS DOUBLE)) AS BIGINT) AS quota FROM n),
epochs AS (SELECT *, least(quota // held, {EPOCHS}) AS whole FROM quotas),
ordered AS (SELECT d.*, whole, quota - whole * held AS rest, {md5_bits_sql(f"'{SEED}:' || CAST(whole AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')", 15)} AS h FROM docs d JOIN epochs USING (domain, l, s)),
reached AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, l, s ORDER BY h, doc_id NULLS FIRST) AS reach FROM ordered),
copies AS (SELECT *, CAST(whole + CASE WHEN reach <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM reached)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(unnest(range(n)) AS INTEGER) AS epoch FROM copies"""

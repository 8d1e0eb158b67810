"""Streamed outcomes of contracts equal those of the batch, and a batch that is repeated sends nothing twice."""

from pyspark.sql import functions as F

from loomstate.operators import contracts, logs
from loomstate.streaming import breaches, ledger_stream

SF = "/root/testdata/sf0.001"


def test_streamed_breaches_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    whole = events.toPandas().sort_values("ts")
    for i in range(4):
        part = whole.iloc[i * len(whole) // 4 : (i + 1) * len(whole) // 4]
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    settled = breaches.settle_stream(stream, "signup", "purchase", 12 * 3600, "1 hour")
    found = ledger_stream.run_to_end(settled, str(tmp_path / "check"), "append", "settled")
    expected = contracts.expectations(contracts.instances(events, "signup"), events, "purchase", "12 hours")
    upto = events.agg(F.max("ts")).first()[0]
    told = expected.withColumn("outcome", F.when(F.col("seen_at").isNotNull(), "satisfied").when(F.col("due_at") <= F.lit(upto) - F.expr("interval 1 hour"), "breached")).where("outcome is not null")
    plain = lambda df, who: df.select(F.col(who).cast("long").alias("who"), F.col("due_at").cast("timestamp").alias("due_at"), "outcome")
    # The watermark ends between two events; what is due behind it may have been closed by a later event of the user's own.
    extra = logs.agreement(plain(found, "correlation"), plain(told, "user_id")).collect()
    assert not [r for r in extra if r["side"] == "b"]
    assert all(r["outcome"] == "breached" and r["due_at"] <= upto for r in extra)
    assert found.where("outcome = 'breached'").count() > 10 and found.where("outcome = 'satisfied'").count() > 0
    assert found.groupBy("correlation").count().where("count > 1").count() == 0


def test_sent_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "effect_key string, args long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    breaches.sent_once(stream, "effect_key", out, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    breaches.sent_once(stream.where("args > 1"), "effect_key", out, str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([("c", 3), ("a", 1)], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    breaches.sent_once(stream, "effect_key", out, str(tmp_path / "c1")).awaitTermination()
    assert sorted(r["effect_key"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]

"""Stores of logs as tables of frames: what is written, what is durable, and positions that must lie between frames.

frames: execution_id, seq, size, offset, end_pos, durable. Frames are appended behind what is written and aren't durable until a
commit reaches them; a commit makes a prefix durable. positions: execution_id, position, a row for each log that is asked of; a
position that is refused is an error of the job, or a row of `refused`, which tells the reason without failing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ID = "execution_id"
FRAME = [ID, "seq", "size", "offset", "end_pos", "durable"]


def ends(frames: DataFrame) -> DataFrame:
    """execution_id, written_end, sync_position: the bytes of each log, and those that are durable."""
    return frames.groupBy(ID).agg(F.coalesce(F.max("end_pos"), F.lit(0)).alias("written_end"), F.coalesce(F.max(F.when(F.col("durable"), F.col("end_pos"))), F.lit(0)).alias("sync_position"))


def append(frames: DataFrame, new: DataFrame) -> DataFrame:
    """frames with new ones (execution_id, seq, size) behind each log's end, in the order of seq; not durable."""
    order = Window.partitionBy(ID).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = new.join(ends(frames), ID, "left").withColumn("end_pos", F.coalesce("written_end", F.lit(0)) + F.sum("size").over(order))
    placed = placed.withColumn("offset", F.col("end_pos") - F.col("size")).withColumn("durable", F.lit(False))
    return frames.select(*FRAME).unionByName(placed.select(*(F.col(c).cast(frames.schema[c].dataType).alias(c) for c in FRAME)))


def _judged(frames: DataFrame, positions: DataFrame, durable_only: bool) -> DataFrame:
    """positions with written_end, sync_position and between, whether the position lies between frames (or at an end)."""
    seen = frames.where("durable") if durable_only else frames
    at = positions.join(seen.select(ID, "offset", "end_pos"), ID, "left").groupBy(ID, "position")
    between = at.agg((F.coalesce(F.bool_or((F.col("offset") == F.col("position")) | (F.col("end_pos") == F.col("position"))), F.lit(False)) | (F.col("position") == 0)).alias("between"))
    told = between.join(ends(frames), ID, "left")
    return told.fillna(0, ["written_end", "sync_position"])


def _problem(action: str) -> Column:
    if action == "commit":
        return F.when(F.col("position") > F.col("written_end"), "beyond the written end").when(~F.col("between"), "inside a frame")
    return F.when(F.col("position") > F.col("sync_position"), "beyond the durable end").when(~F.col("between"), "inside a frame")


def refused(frames: DataFrame, positions: DataFrame, action: str) -> DataFrame:
    """execution_id, position, problem of what commit, read or truncate would refuse."""
    return _judged(frames, positions, action != "commit").withColumn("problem", _problem(action)).where("problem is not null").select(ID, "position", "problem")


def _at(frames: DataFrame, positions: DataFrame, action: str) -> DataFrame:
    """frames with their log's position; null for logs that aren't asked of. A refused position fails the job."""
    judged = _judged(frames, positions, action != "commit").withColumn("_p", _problem(action))
    told = F.raise_error(F.concat(F.lit(f"{action} at "), F.col("position").cast("string"), F.lit(": "), F.col("_p"))).cast("long")
    return frames.join(judged.select(ID, F.when(F.col("_p").isNull(), F.col("position")).otherwise(told).alias("position")), ID, "left")


def commit_prefix(frames: DataFrame, positions: DataFrame) -> DataFrame:
    """frames, those that end by their log's position durable. What was durable stays so."""
    reached = F.coalesce(F.col("end_pos") <= F.col("position"), F.lit(False))
    return _at(frames, positions, "commit").withColumn("durable", F.col("durable") | reached).select(*FRAME)


def commit_all(frames: DataFrame) -> DataFrame:
    return frames.withColumn("durable", F.lit(True))


def read_from(frames: DataFrame, positions: DataFrame) -> DataFrame:
    """The durable frames behind each log's position; none of logs that aren't asked of."""
    return _at(frames.where("durable"), positions, "read").where("offset >= position").select(*FRAME)


def truncate_to(frames: DataFrame, positions: DataFrame) -> DataFrame:
    """frames without those behind their log's position, and without what isn't durable in these logs."""
    return _at(frames, positions, "truncate").where("position is null or (durable and end_pos <= position)").select(*FRAME)


def rolled_back(frames: DataFrame) -> DataFrame:
    """What a crash leaves: the durable frames."""
    return frames.where("durable")


def create(frames: DataFrame, path: str) -> None:
    """Writes the durable frames as a new store at path; what was there is gone. A store's files are of whole logs' parts, by execution."""
    rolled_back(frames).repartition(ID).sortWithinPartitions(ID, "seq").write.mode("overwrite").parquet(path)


def extend(frames: DataFrame, path: str) -> None:
    """Adds durable frames to the store at path, behind those that it has; none that it has already, so that a lost job may run again."""
    held = open_store(frames.sparkSession, path).select(ID, "end_pos")
    rolled_back(frames).join(held, [ID, "end_pos"], "left_anti").select(*FRAME).repartition(ID).sortWithinPartitions(ID, "seq").write.mode("append").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The frames of the store at path, all durable."""
    return spark.read.parquet(path).select(*FRAME)

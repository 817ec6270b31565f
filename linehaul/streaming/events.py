"""The run event log as a stream: a folder of JSON files, one per batch."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from linehaul.operators.numbering import numbered
from linehaul.scratch import Scratch
from linehaul.sources import artifacts as A

EVENT = StructType([StructField("run", StringType()), StructField("seq", LongType()), StructField("ts", TimestampType()), StructField("type", StringType()), StructField("payload", StringType())])
#: Types that the worker writes itself and does not import from a run's own log.
OWN_TYPES = ("run.started", "run.finished", "run.failed", "run.paused")
TERMINAL = ("run.finished", "run.failed", "run.cancelled")


def append_events(folder: str, events: list[dict]) -> str:
    """Write events as one complete file: a reader never sees half a line."""
    os.makedirs(folder, exist_ok=True)
    name = f"{uuid.uuid4().hex}.json"
    temp = os.path.join(folder, f".{name}.part")
    with open(temp, "w") as out:
        out.writelines(json.dumps(e) + "\n" for e in events)
    os.replace(temp, os.path.join(folder, name))
    return os.path.join(folder, name)


def read_events(spark: SparkSession, folder: str, own: bool = False) -> DataFrame:
    """The log as a stream; the query's checkpoint is the cursor."""
    events = spark.readStream.schema(EVENT).json(folder)
    return events if own else events.where(~F.col("type").isin(*OWN_TYPES))


def counts(events: DataFrame, late: str = "10 minutes", window: str = "15 minutes") -> DataFrame:
    """Events per tumbling window and type; what comes later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "type").agg(F.count(F.lit(1)).alias("n"))


def run_states(events: DataFrame) -> DataFrame:
    """Per run its newest status, sequence and heartbeat, as a streaming aggregation (update or complete mode)."""
    by = F.struct("ts", "seq")
    return events.groupBy("run").agg(F.max_by("type", by).alias("status"), F.max("seq").alias("seq"), F.max("ts").alias("heartbeat"), F.count(F.when(F.col("type") == "checkpoint", 1)).alias("checkpoints"))


#: Runs are dealt to so many folders of a table, so that a batch reads the keys of its own runs' folders alone.
BUCKETS = 64


def _bucket(run: str = "run"):
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


def _kept(spark: SparkSession, target: str, batch: DataFrame, schema: str) -> DataFrame | None:
    """Rows of a table in the folders of the batch's runs; None where there is no table yet."""
    if not A.exists(spark, target):
        return None
    # at most BUCKETS numbers
    mine = [r["b"] for r in batch.select(_bucket().alias("b")).distinct().collect()]
    return spark.read.schema(f"{schema}, bucket int").parquet(target).where(F.col("bucket").isin(mine))


def import_log(events: DataFrame, target: str, checkpoint: str):
    """Import into a table exactly once per (run, seq), however late: a redelivered event is dropped. Returns the started query.

    Each batch is held against the keys that the table has of its runs' folders, so a batch repeated after a failure
    adds nothing twice. One import writes to a table at a time. A table that Spark's file sink wrote (with a
    ``_spark_metadata`` folder) is refused, as what is added to it could not be read.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if A.exists(spark, f"{target}/_spark_metadata"):
            raise ValueError(f"{target} was written by the file sink")
        new = batch.dropDuplicates(["run", "seq"])
        done = _kept(spark, target, batch, "run string, seq long")
        if done is not None:
            done = done.select(F.col("run").alias("_run"), F.col("seq").alias("_seq"))
            new = new.join(done, F.col("run").eqNullSafe(F.col("_run")) & F.col("seq").eqNullSafe(F.col("_seq")), "left_anti")
        new.withColumn("bucket", _bucket()).write.mode("append").partitionBy("bucket").parquet(target)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ARRIVING = "run string, event string, ts timestamp, type string, payload string"
_NUMBERED = f"{ARRIVING}, seq long"


def append_numbered(events: DataFrame, target: str, checkpoint: str):
    """Append events (see ``ARRIVING``) with gapless numbers per run, from 0, in order of ts and event id. Returns the started query.

    An event id comes once into a run, however often it is delivered: what the table has of it stays as it is. A batch
    is numbered by ranges of all its rows, so that one run with most of them is no single task, and goes on from the
    largest number that the table has of the run. It is written to a folder of the attempt and renamed into place, so
    that a batch that is repeated after a failure finds either all of its events or none. One stream writes to a table
    at a time. An event without run, id, time or type is an error and stops the stream before anything is written.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        scratch = Scratch(spark, "events")
        batch = scratch.table(batch.select("run", "event", "ts", "type", "payload"), "batch")
        if batch.where("run IS NULL OR event IS NULL OR ts IS NULL OR type IS NULL OR trim(run) = '' OR trim(type) = ''").limit(1).count():
            raise ValueError("an event lacks its run, id, time or type")
        new = batch.groupBy("run", "event").agg(F.min(F.struct("ts", "type", "payload")).alias("e")).select("run", "event", "e.*")
        parts = f"{target}/batches"
        done = _kept(spark, parts, batch, _NUMBERED) if A.exists(spark, parts) and A.folders(spark, parts) else None
        if done is not None:
            new = new.join(done.select("run", "event"), ["run", "event"], "left_anti")
        placed = scratch.table(numbered(new, ["run", "ts", "event"], "_place", scratch), "placed")
        first = placed.groupBy("run").agg(F.min("_place").alias("_first"))
        if done is not None:
            first = first.join(done.groupBy("run").agg((F.max("seq") + 1).alias("_next")), "run", "left")
        else:
            first = first.withColumn("_next", F.lit(0))
        rows = placed.join(first, "run").select("run", "event", "ts", "type", "payload", (F.col("_place") - F.col("_first") + F.coalesce("_next", F.lit(0))).cast("long").alias("seq"))
        attempt = f"{target}/_attempts/{uuid.uuid4().hex}"
        rows.withColumn("bucket", _bucket()).write.partitionBy("bucket").parquet(attempt)
        A.rename_once(spark, attempt, f"{parts}/batch={uuid.uuid4().hex}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered_events(spark: SparkSession, target: str) -> DataFrame:
    """The events that ``append_numbered`` has committed."""
    return spark.read.schema(f"{_NUMBERED}, bucket int").parquet(f"{target}/batches").drop("bucket", "batch")


def conflicts(events: DataFrame) -> DataFrame:
    """Redelivered (run, seq) whose payload differs."""
    return events.groupBy("run", "seq").agg(F.countDistinct("payload").alias("payloads")).where("payloads > 1")


def replay(log: DataFrame, run: str, after: int) -> DataFrame:
    """A run's events after a sequence number, in order."""
    return log.where((F.col("run") == run) & (F.col("seq") > after)).orderBy("seq")

"""Incremental jobs: ingest once, newest row per key, first row per key, and daily to monthly alignment of arrivals."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import keep_last


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Arrivals of Parquet files in a folder (or of a single file); the query's checkpoint remembers which were read, so none is read twice."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        reader, path = reader.option("pathGlobFilter", target.getName()), target.getParent().toString()
    return reader.parquet(path)


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived, write it exactly once, and stop."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def first_by_key(stream: DataFrame, keys: list[str], time: str, lateness: str | None = None) -> DataFrame:
    """The first arrival of each key; keys are forgotten once the watermark has passed them by ``lateness``, never without one.

    A live stream needs a lateness, which bounds the state; rows later than that are dropped. A finished table whose files
    come in no order of time must not have one.
    """
    if lateness is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


#: Batches after which an upsert folds their folders into a base.
BATCHES_HELD = 16


def upsert_to_end(stream: DataFrame, sink: str, checkpoint: str, keys: list[str], order: str, held: int = BATCHES_HELD) -> None:
    """Write the newest row of each key of every batch, tagged with the batch; ``newest`` reads them. A batch that is run again replaces its own rows.

    After each ``held`` batches their folders are folded into a new base, so that readers meet one base and ``held`` folders at most.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        keep_last(batch, keys, order).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        if (batch_id + 1) % held == 0:
            compact(batch.sparkSession, sink, keys, order, batch_id)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, sink: str, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key over the base and all batches since; of equal orders that of the later batch."""
    return _newest(spark, sink, keys, order).drop("batch")


def _folders(spark: SparkSession, sink: str) -> tuple[int | None, list[int], list[int]]:
    """(the last batch that the newest base holds, batches since it, what bases and batches are older)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sink)
    names = [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    found = {kind: sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}=(\d+)", n))) for kind in ("base", "batch")}
    base = found["base"][-1] if found["base"] else None
    return base, [b for b in found["batch"] if base is None or b > base], found["base"][:-1]


def _newest(spark: SparkSession, sink: str, keys: list[str], order: str, upto: int | None = None) -> DataFrame:
    base, batches, _ = _folders(spark, sink)
    paths = [f"{sink}/batch={b}" for b in batches if upto is None or b <= upto]
    parts = [spark.read.parquet(p).withColumn("batch", F.lit(int(p.rpartition("=")[2])).cast("long")) for p in paths]
    if base is not None:
        parts.insert(0, spark.read.parquet(f"{sink}/base={base}"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return keep_last(rows.withColumn("_at", F.struct(F.col(order).alias("o"), F.col("batch").alias("b"))), keys, "_at").drop("_at")


def compact(spark: SparkSession, sink: str, keys: list[str], order: str, upto: int) -> None:
    """Fold the base and all batches to ``upto`` into a new base, then delete what it holds.

    The base is written aside and appears by one rename. Whatever dies before that leaves the folders as they were; whatever
    dies after it leaves folders that no reader looks at, which the next run deletes. The base before the last one stays
    until then, with the batches since it, for readers that listed the folder before the rename.
    """
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/{name}")
    fs = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    before = _folders(spark, sink)
    if before[0] is not None and before[0] >= upto:
        return  # a batch that is run again
    aside = f"_making-{uuid.uuid4().hex}"
    _newest(spark, sink, keys, order, upto).write.parquet(f"{sink}/{aside}")
    if not fs.rename(path(aside), path(f"base={upto}")):
        raise OSError(f"{sink}: base={upto} could not be put in place")
    for status in fs.listStatus(path("")):
        name = status.getPath().getName()
        number = re.fullmatch(r"(base|batch)=(\d+)", name)
        old = number and before[0] is not None and int(number[2]) <= before[0] and name != f"base={before[0]}"
        if old or name.startswith("_making-"):
            fs.delete(status.getPath(), True)


def daily_sums(stream: DataFrame, time: str, keys: list[str], value: str, lateness: str | None = None) -> DataFrame:
    """(keys, date, value, n) by day, updated as rows arrive; with a ``lateness`` days older than the watermark are final and later rows dropped."""
    days = (stream if lateness is None else stream.withWatermark(time, lateness)).groupBy(F.window(time, "1 day"), *keys).agg(F.sum(value).alias("value"), F.count("*").alias("n"))
    return days.select(*keys, F.to_date("window.start").alias("date"), "value", "n")


def align_to_end(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Write every update of ``daily_sums``, tagged with its batch; ``monthly_from_updates`` reads them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def monthly_from_updates(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """(keys, date, value, n): the last update of each day, summed to month ends; months are no windows of fixed length."""
    days = keep_last(spark.read.parquet(sink), [*keys, "date"], "batch")
    return days.groupBy(*keys, F.last_day("date").alias("month")).agg(F.sum("value").alias("value"), F.sum("n").alias("n")).withColumnRenamed("month", "date")

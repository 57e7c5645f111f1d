"""Incremental ingestion of images and streaming daily means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamline.functions.missing import present
from loamline.operators.readings import readings_of
from loamline.session import work_path

ROWS_A_FILE = 2_000_000


def daily_mean_stream(obs: DataFrame, value: str = "value", time: str = "time", key: str = "gpi", late: str = "30 days") -> DataFrame:
    """Mean by key and day of a stream; readings later than ``late`` are dropped by the watermark."""
    stamped = obs.withColumn("_t", F.col(time).cast("timestamp"))
    day = F.window("_t", "1 day")
    return stamped.withWatermark("_t", late).groupBy(key, day).agg(F.avg(present(F.col(value))).alias(value), F.count(present(F.col(value))).alias("n")).select(key, F.col("window.start").cast("timestamp_ntz").alias("day"), value, "n")


def first_deliveries(obs: DataFrame, keys: list[str], time: str = "ingested_at", within: str = "60 days") -> DataFrame:
    """A stream without repeated deliveries: a key counts once within the watermark."""
    return obs.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", within).dropDuplicatesWithinWatermark(keys).drop("_t")


def append_cells(obs: DataFrame, grid: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """New images appended to the series by cell, batch by batch; restarts from its checkpoint without loss.

    A batch is written under its own number, so a repeated batch replaces itself.  A cell with more than ROWS_A_FILE rows of a
    batch is cut into as many parts."""
    cells = grid.select("gpi", "cell")

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.drop("cell").join(cells, "gpi").withColumn("batch", F.lit(number))
        large = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROWS_A_FILE).cast("int").alias("_parts")).where("_parts > 1")
        rows = rows.join(large, "cell", "left").withColumn("_part", F.pmod(F.xxhash64("gpi", "time"), F.coalesce("_parts", F.lit(1))))
        rows.repartition("cell", "_part").sortWithinPartitions("cell", "gpi", "time").drop("_parts", "_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "cell").parquet(path)

    return obs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint or work_path(obs.sparkSession, "stream")).trigger(availableNow=True).start()


def readings_stream(spark: SparkSession, folder: str, sensor: str = "smap") -> DataFrame:
    """A table folder as a stream of readings with ``time``."""
    schema = spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).parquet(folder)
    return readings_of(raw, sensor).withColumn("time", F.timestamp_seconds("unix").cast("timestamp_ntz"))


def stored_results(stream: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """The whole result of an aggregating stream as a table that is replaced after every batch."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint or work_path(stream.sparkSession, "stream")).trigger(availableNow=True).start()

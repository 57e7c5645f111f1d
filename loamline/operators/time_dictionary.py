"""Mixed time notations to one UTC instant (problem 5): each distinct text of a source is parsed once, and the dictionary is
kept, so a later run parses only what is new."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions.instants import instant_ms
from loamline.operators.skew import hot_aware_join
from loamline.session import cut, shared_folder, work_path

KEYS = ["sensor", "raw", "units", "site"]
ENTRY = "sensor string, raw string, units string, site string, base_ms long"
#: Counts up with every change of what a text denotes: a kept dictionary of other readings is not used.
PARSER = 2
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ms = [instant_ms(r, u or None, s or None) for r, u, s in zip(*(batch.column(k).to_pylist() for k in KEYS[1:]), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEYS), pa.array(ms, pa.int64())], names=[*KEYS, "base_ms"])


class TimeDictionary:
    """A Parquet dictionary (sensor, raw, units, site) -> base_ms below ``root`` that grows by what it does not know yet.

    NULL sensors, units and sites are stored as empty text; texts without one digit fix no instant and are never stored."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.parts = spark, root, 0

    def read(self) -> DataFrame:
        """The whole dictionary."""
        if not self.parts and not self._exists():
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(self.root)

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def extend(self, values: DataFrame) -> None:
        """Parse the distinct keys that are not in the dictionary, and append them.  Writers at the same time may leave a key
        twice, with the same instant."""
        fresh = values.select(*KEYS).distinct()
        if self.parts or self._exists():
            fresh = fresh.join(self.read().select(*KEYS), KEYS, "left_anti")
        fresh.mapInArrow(_parse, ENTRY).write.mode("append").parquet(self.root)
        self.parts += 1


def kept_dictionary(spark: SparkSession) -> TimeDictionary:
    """The dictionary that stays in the shared folder from run to run."""
    return TimeDictionary(spark, f"{shared_folder(spark)}/time-dictionary-{PARSER}")


def keyed(rows: DataFrame) -> DataFrame:
    """The dictionary's keys beside the rows; rows whose text has no digit are dropped, they denote no instant."""
    sensor = F.coalesce("sensor", F.lit("")) if "sensor" in rows.columns else F.lit("")
    return rows.withColumns(
        {"sensor": sensor, "raw": F.col("acquisition_time"), "units": F.coalesce("time_units", F.lit("")), "site": F.coalesce("site_zone", F.lit(""))}
    ).where(F.col("raw").rlike(r"\d"))


def whole_offset_ms() -> F.Column:
    """time_offset cut toward zero to a whole number of its unit (first letter, any case), in ms; NULL if it is missing
    or its unit is unknown."""
    unit = F.lower(F.substring(F.trim("timeoffsetunit"), 1, 1))
    seconds = F.lit(None).cast("long")
    for letter, s in UNIT_SECONDS.items():
        seconds = F.when(unit == letter, F.lit(s).cast("long")).otherwise(seconds)
    offset = F.when(~F.isnan("time_offset") & (F.abs("time_offset") < 1e12), F.col("time_offset"))
    return F.when(offset < 0, F.ceil(offset)).otherwise(F.floor(offset)).cast("long") * seconds * 1000


def normalise_times(rows: DataFrame, dictionary: TimeDictionary | None = None) -> DataFrame:
    """(reading_id, utc_ms) for each reading whose text denotes exactly one instant, each once.

    Text is looked up in the dictionary (extended first; by default a new one in the shared folder); where
    ``timeoffsetvarname`` is set, ``time_offset`` is added, and a missing one leaves no instant.  Rows with a NULL
    reading_id are dropped; exact repeats count once.  A text shared by a large part of the rows is joined by
    broadcast, so it can't overload a task.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    dictionary = dictionary or TimeDictionary(spark, work_path(spark, "times"))
    wanted = keyed(rows.where("reading_id IS NOT NULL"))
    counts = cut(wanted.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows")), "time-texts")
    dictionary.extend(counts)
    known = cut(dictionary.read().where("base_ms IS NOT NULL").join(counts, KEYS), "time-known")
    slim = wanted.select("reading_id", *KEYS, "timeoffsetvarname", "time_offset", "timeoffsetunit")
    shift = F.when(F.col("timeoffsetvarname").isNull(), F.lit(0).cast("long")).otherwise(whole_offset_ms())
    return (
        hot_aware_join(slim, known, KEYS, "rows")
        .select("reading_id", (F.col("base_ms") + shift).alias("utc_ms"))
        .where("utc_ms IS NOT NULL")
        .distinct()
    )


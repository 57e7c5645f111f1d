"""Millions of tiny files into few well-sized ones (problem 2).

Partition-local: only partitions (reader and period) that hold too many small files, and have changed since they were last
written, are rewritten.  A rewrite overwrites its partitions dynamically, under numbered snapshots: it goes to files of its
own, and a manifest names the folder that holds each partition.  The writer claims the next snapshot number by creating a
file exclusively, asks after the write whether its input is still the same, and publishes the manifest by a rename.  Until
then, and after a crash, readers see the snapshot before.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.functions.strptime import strptime_parts
from loamline.session import EngineError, cut, work_path

MISSING_TEXT = ("", "nan", "n/a", "na", "null", "none", "-", "-9999", "-9999.0")
#: A reader is cut into years once a year holds so many files of the target size.
FILES_A_YEAR = 4


class Conflict(EngineError):
    """Another writer got there first, or the input changed during a rewrite."""


def glob_regex(pattern: str) -> str:
    """A whole-path regular expression for a glob: ``**/`` any depth, ``*`` and ``?`` within one name, ``[...]`` sets."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"^{out}$"


def template_regex(template: str, fmt: str) -> str:
    """A base-name regular expression for a file-name template; group 1 is the time."""
    parts = re.split(r"(\{datetime\}|\*)", template)
    return "^" + "".join({"{datetime}": f"({strptime_parts(fmt)[0]})", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts) + "$"


def rules_of(readers: DataFrame) -> DataFrame:
    """(reader_name, regex, java_format, target_bytes) of complete reader rows: one expression for the whole path, its group 1
    the time.  Of several rows of a reader the smallest counts."""

    @F.pandas_udf("regex string, java_format string")
    def compiled(pattern: pd.Series, template: pd.Series, fmt: pd.Series) -> pd.DataFrame:
        rows = [(f"^(?={glob_regex(p)[1:]})(?:.*/)?{template_regex(t, f)[1:]}", strptime_parts(f)[1]) for p, t, f in zip(pattern, template, fmt, strict=True)]
        return pd.DataFrame(rows, columns=["regex", "java_format"])

    whole = readers.where("reader_name IS NOT NULL AND pattern IS NOT NULL AND fname_templ IS NOT NULL AND datetime_format IS NOT NULL")
    one = whole.groupBy("reader_name").agg(F.min(F.struct("pattern", "fname_templ", "datetime_format", "target_bytes")).alias("r"))
    return cut(one.select("reader_name", compiled("r.pattern", "r.fname_templ", "r.datetime_format").alias("c"), F.col("r.target_bytes").cast("long").alias("target_bytes")).select("reader_name", "c.*", "target_bytes"), "rules")


def matched_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files whose path matches their reader's pattern and whose base name matches its template with a real time.

    Adds ``image_time`` and ``target_bytes``.  Files of unknown readers, or with a NULL path, are no matches."""
    own = [c for c in files.columns if c not in ("image_time", "target_bytes")]
    text = F.call_function("regexp_extract", F.col("path"), F.col("regex"), F.lit(1))
    joined = files.select(*own).join(rules, "reader_name").withColumn("image_time", F.try_to_timestamp(text, F.col("java_format")).cast("timestamp_ntz"))
    return joined.where("image_time IS NOT NULL").select(*own, "image_time", "target_bytes")


def number_or_null(text: Column) -> Column:
    """A number in any usual notation; missing spellings, NaN and -9999 are NULL."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.lower(F.trim(text)).isin(*MISSING_TEXT) & ~F.isnan(value) & (value != -9999), value)


def csv_records(matched: DataFrame) -> DataFrame:
    """The records of CSV contents ``gpi,ssm,ssm_noise``: header lines and lines without a whole gpi are none.  Any line
    end will do; a NULL or empty content has no record."""
    lines = matched.select("reader_name", "image_time", "file_id", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("line", "text"))
    cells = lines.withColumn("cell", F.split("text", ","))
    gpi = F.trim(F.get("cell", F.lit(0))).try_cast("double")
    return cells.where((gpi == F.floor(gpi)) & (F.abs(gpi) < 2**53)).select(
        "reader_name", "image_time", "file_id", "line", gpi.cast("long").alias("gpi"), number_or_null(F.get("cell", F.lit(1))).alias("ssm"), number_or_null(F.get("cell", F.lit(2))).alias("ssm_noise")
    )


class SnapshotTable:
    """A partitioned Parquet table with numbered snapshots beside its data.

    ``_snapshots/vN.json`` is a manifest: for each partition its folder below ``data`` and what the writer noted of it, so it
    grows with the partitions, not with files or records.  Folders of a write are never changed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.data = spark, root, f"{root}/data"
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def version(self) -> int:
        """The number of the newest published snapshot; 0 before the first."""
        folder = self._path(f"{self.root}/_snapshots")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if re.fullmatch(r"v\d+\.json", n)), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a snapshot (default: the newest); without partitions before the first."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "partitions": {}}
        stream = self._fs.open(self._path(f"{self.root}/_snapshots/v{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, content: dict) -> None:
        try:
            stream = self._fs.create(self._path(f"{self.root}/_snapshots/{name}"), False)
        except Exception as e:
            raise Conflict(f"snapshot file {name} exists: another writer is at work") from e
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()

    def _delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def _publish(self, version: int, content: dict) -> None:
        """The manifest appears under its name at once and whole; only the holder of the claim does this."""
        draft = f"v{version}.{uuid.uuid4().hex}.draft"
        self._write(draft, content)
        if not self._fs.rename(self._path(f"{self.root}/_snapshots/{draft}"), self._path(f"{self.root}/_snapshots/v{version}.json")):
            raise Conflict(f"snapshot {version} could not be published")

    def release(self, version: int) -> None:
        """Give up the claim that a crashed writer left on a snapshot number."""
        self._delete(f"{self.root}/_snapshots/v{version}.claim")

    def overwrite_partitions(self, df: DataFrame, partition: list[str], based_on: int, unchanged: Callable[[], bool], notes: dict[str, dict] | None = None) -> int:
        """Replace the partitions that occur in ``df``; the others stay.  ``based_on`` is the version the caller read;
        ``unchanged()`` is asked after the write, before anything is published.  Returns the new version, raises Conflict
        otherwise and leaves the table as it was."""
        if self.version() != based_on:
            raise Conflict(f"the table is at version {self.version()}, not {based_on}")
        claim, folder = f"v{based_on + 1}.claim", f"write={uuid.uuid4().hex}"
        self._write(claim, {})
        try:
            df.write.partitionBy(*partition).parquet(f"{self.data}/{folder}")
            if not unchanged():
                raise Conflict("the input changed during the rewrite")
            if self.version() != based_on:
                raise Conflict(f"the table is at version {self.version()}, not {based_on}")
            found = self._fs.globStatus(self._path(f"{self.data}/{folder}" + "/*=*" * len(partition)))
            new = {s.getPath().toString().split(f"/{folder}/", 1)[1]: s.getPath() for s in found}
            entries = {k: {"write": folder, "bytes": self._fs.getContentSummary(p).getLength(), **(notes or {}).get(k, {})} for k, p in new.items()}
            self._publish(based_on + 1, {"version": based_on + 1, "schema": df.schema.json(), "partitions": self.manifest(based_on)["partitions"] | entries})
        except BaseException:
            self._delete(f"{self.data}/{folder}")
            raise
        finally:
            self._delete(f"{self.root}/_snapshots/{claim}")
        return based_on + 1

    def read(self, version: int | None = None) -> DataFrame:
        """The records of a snapshot (default: the newest), of its own folders only."""
        from pyspark.sql.types import StructType

        m = self.manifest(version)
        if not m["partitions"]:
            raise EngineError("the table has no records yet")
        schema = StructType.fromJson(json.loads(m["schema"]))
        paths = [f"{self.data}/{e['write']}/{k}" for k, e in sorted(m["partitions"].items())]
        return self.spark.read.schema(schema).option("basePath", self.data).parquet(*paths).select(*schema.names)

    def expire(self, keep: int = 2) -> int:
        """Delete the folders that none of the last ``keep`` snapshots needs, and older manifests; returns how many folders."""
        newest = self.version()
        kept = {e["write"] for v in range(max(1, newest - keep + 1), newest + 1) for e in self.manifest(v)["partitions"].values()}
        for v in range(1, newest - keep + 1):
            self._delete(f"{self.root}/_snapshots/v{v}.json")
        old = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.data)) if s.getPath().getName() not in kept]
        for name in old:
            self._delete(f"{self.data}/{name}")
        return len(old)


def _hashed() -> Column:
    return F.xxhash64("file_id", "path", "content").cast("decimal(20,0)")


def _fingerprint(files: Column, hashes: Column) -> Column:
    """A count and a sum of hashes, so repeated rows can't cancel out."""
    return F.concat_ws("-", files, hashes.cast("decimal(38,0)").cast("string"))


def small_file_plan(matched: DataFrame, small_files: int, periods: dict[str, str] | None = None) -> DataFrame:
    """Per reader and period: files, bytes, and a fingerprint of the input; ``crowded`` where more than ``small_files`` files are below the target size.

    The period is the year of the image time where a year of the reader holds FILES_A_YEAR files of the target size, else
    ``all``; a reader in ``periods`` keeps the kind of period it has there."""
    size = F.coalesce(F.octet_length("content").cast("long"), F.lit(0))
    by_year = matched.groupBy("reader_name", F.year("image_time").cast("string").alias("year")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.max("target_bytes").alias("target_bytes"), F.count_if(size < F.col("target_bytes")).alias("small"), F.sum(_hashed()).alias("hashes")
    )
    usual = F.when(F.sum("bytes") >= FILES_A_YEAR * F.count(F.lit(1)) * F.max("target_bytes"), "year").otherwise("all")
    kind = usual
    if periods:
        known = F.create_map(*(F.lit(x) for pair in periods.items() for x in pair))
        kind = F.coalesce(known[F.col("reader_name")], usual)
    by_year = cut(by_year, "by-year")
    kinds = by_year.groupBy("reader_name").agg(kind.alias("kind"))
    plan = by_year.join(kinds, "reader_name").groupBy("reader_name", F.when(F.col("kind") == "year", F.col("year")).otherwise("all").alias("period"))
    sums = plan.agg(*(F.sum(c).alias(c) for c in ("files", "bytes", "small", "hashes")), F.max("target_bytes").alias("target_bytes"))
    return sums.select("reader_name", "period", "files", "bytes", "small", "target_bytes", _fingerprint(F.col("files"), F.col("hashes")).alias("fingerprint"), (F.col("small") > small_files).alias("crowded"))


def compact(files: DataFrame | Callable[[], DataFrame], readers: DataFrame, root: str, small_files: int = 1) -> tuple[SnapshotTable, DataFrame]:
    """Consolidate the matching files of each reader into files of about ``target_bytes`` below ``root``.

    Each record (reader, image time, gpi) comes out once, as in the matching file of smallest file_id (in one file: its
    first line), with that ``file_id`` as origin.  Files are counted by what a record takes once it is compressed, as
    measured on all records of this run, and hot readers are spread over their files.  ``files`` is the whole input; given as
    a function it is read anew for the check after the write, so deliveries meanwhile are noticed.  Returns the table and
    the plan, with ``rewrite`` where a partition is crowded and not yet in the table as it is now.  Repeated rows of one file
    count once by nature; an empty input leaves an empty table at version 0."""
    source, rules = files if callable(files) else lambda: files, rules_of(readers)
    matched = cut(matched_files(source(), rules).select("reader_name", "image_time", "file_id", "path", "content", "target_bytes"), "matched")
    return _compact(matched, source, rules, root, small_files)


def _compact(matched: DataFrame, source: Callable[[], DataFrame], rules: DataFrame, root: str, small_files: int) -> tuple[SnapshotTable, DataFrame]:
    spark = matched.sparkSession
    table = SnapshotTable(spark, root)
    before = table.manifest()
    periods = {e["reader"]: e["kind"] for e in before["partitions"].values()}
    plan = small_file_plan(matched, small_files, periods).withColumn("rewrite", F.col("crowded"))
    known = [(e["reader"], e["period"], e["fingerprint"]) for e in before["partitions"].values()]
    if known:
        same = spark.createDataFrame(known, "reader_name string, period string, fingerprint string").withColumn("written", F.lit(True))
        plan = plan.join(same, ["reader_name", "period", "fingerprint"], "left").withColumn("rewrite", F.col("crowded") & F.col("written").isNull()).drop("written")
    todo = plan.where("rewrite").collect()  # one row per partition to write
    if not todo:
        return table, plan
    kinds = {(r.reader_name, "all" if r.period == "all" else "year") for r in todo}
    wanted = spark.createDataFrame([(r.reader_name, r.period) for r in todo], "reader_name string, period string")
    by_reader = spark.createDataFrame(sorted(kinds), "reader_name string, kind string")
    period = F.when(F.col("kind") == "year", F.year("image_time").cast("string")).otherwise("all")
    chosen = matched.join(by_reader, "reader_name").withColumn("period", period).join(wanted, ["reader_name", "period"], "left_semi")
    first = (
        csv_records(chosen)
        .groupBy("reader_name", "image_time", "gpi")
        .agg(F.min(F.struct("file_id", "line", "ssm", "ssm_noise")).alias("r"))
        .select("reader_name", "image_time", "gpi", "r.file_id", "r.ssm", "r.ssm_noise")
    )
    path = work_path(spark, "records")
    first.sortWithinPartitions("reader_name", "image_time", "gpi").write.option("compression", "zstd").parquet(path)
    records = spark.read.schema(first.schema).parquet(path).join(by_reader, "reader_name").withColumn("period", period).drop("kind")
    images = cut(records.groupBy("reader_name", "period", "image_time").agg(F.count(F.lit(1)).alias("size")), "images")
    sizes = {(r.reader_name, r.period): r.n for r in images.groupBy("reader_name", "period").agg(F.sum("size").alias("n")).collect()}
    taken = table._fs.getContentSummary(table._path(path)).getLength()
    a_record = taken / max(sum(sizes.values()), 1)
    slots, offset = [], 0
    for r in todo:
        total = sizes.get((r.reader_name, r.period), 0)
        n = max(1, round(total * a_record / max(r.target_bytes or 1, 1)))
        slots.append((r.reader_name, r.period, offset, n, total))
        offset += n
    places = spark.createDataFrame(slots, "reader_name string, period string, offset int, n int, total long")
    # images stay together in the order of time; one that is larger than a file is spread by its records
    before_it = F.coalesce(F.sum("size").over(Window.partitionBy("reader_name", "period").orderBy("image_time").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = images.withColumn("before", before_it).join(places, ["reader_name", "period"]).drop("period")
    at = F.col("before") + F.pmod(F.xxhash64("image_time", "gpi"), F.col("size"))
    slot = F.col("offset") + F.floor(at * F.col("n") / F.col("total")).cast("int")
    placed = records.join(placed, ["reader_name", "image_time"]).withColumn("slot", slot).repartitionById(offset, "slot")
    rows = placed.sortWithinPartitions("reader_name", "period", "image_time", "gpi").select("image_time", "gpi", "file_id", "ssm", "ssm_noise", "reader_name", "period")
    folder = {(r.reader_name, r.period): f"reader_name={_escaped(spark, r.reader_name)}/period={r.period}" for r in todo}
    notes = {folder[r.reader_name, r.period]: {"reader": r.reader_name, "period": r.period, "kind": "all" if r.period == "all" else "year", "fingerprint": r.fingerprint} for r in todo}
    seen = {(r.reader_name, r.period): r.fingerprint for r in todo}

    def unchanged() -> bool:
        now = matched_files(source(), rules).join(by_reader, "reader_name").withColumn("period", period).join(wanted, ["reader_name", "period"], "left_semi")
        sums = now.groupBy("reader_name", "period").agg(_fingerprint(F.count(F.lit(1)), F.sum(_hashed())).alias("fingerprint"))
        return {(r.reader_name, r.period): r.fingerprint for r in sums.collect()} == seen

    table.overwrite_partitions(rows, ["reader_name", "period"], before["version"], unchanged, notes)
    return table, plan


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as it stands in its folder's name."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def superfluous_files(files: DataFrame | Callable[[], DataFrame], readers: DataFrame) -> DataFrame:
    """(file_id): matching files that gave the compacted table no record."""
    source, rules = files if callable(files) else lambda: files, rules_of(readers)
    matched = cut(matched_files(source(), rules).select("reader_name", "image_time", "file_id", "path", "content", "target_bytes"), "matched")
    spark = matched.sparkSession
    table, plan = _compact(matched, source, rules, work_path(spark, "compacted"), 1)
    left = plan.where("NOT rewrite").select("reader_name", "period")
    giving = None
    if not left.isEmpty():  # partitions without small files to join stay as they are
        kinds = left.select("reader_name", F.when(F.col("period") == "all", "all").otherwise("year").alias("kind")).distinct()
        period = F.when(F.col("kind") == "year", F.year("image_time").cast("string")).otherwise("all")
        giving = csv_records(matched.join(kinds, "reader_name").withColumn("period", period).join(left, ["reader_name", "period"], "left_semi")).groupBy("reader_name", "image_time", "gpi").agg(F.min("file_id").alias("file_id")).select("file_id")
    if table.version():
        written = table.read().select("file_id")
        giving = written if giving is None else giving.unionByName(written)
    every = matched.select("file_id").distinct()
    return every if giving is None else every.join(giving.distinct(), "file_id", "left_anti")

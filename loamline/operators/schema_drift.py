"""Schemas that drift between files (problem 4).

Headers are read in parallel and ordered per stream by one range-partitioned sort, so a hot stream spreads over many
tasks.  Each task compares neighbouring files; the files at the cut between two tasks are compared in a second, small
pass.  Types fold through a promotion lattice into one schema per stream, to which all records are cast.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.session import EngineError, cut

#: Spellings of types in numpy, the array protocol and CDL, by logical type.
SPELLINGS = {
    "i1": "int8 i1 byte", "u1": "uint8 u1 ubyte", "i2": "int16 i2 short", "u2": "uint16 u2 ushort", "i4": "int32 i4 int long", "u4": "uint32 u4 uint",
    "i8": "int64 i8 longlong", "u8": "uint64 u8 ulonglong ulong", "f4": "float32 f4 float real", "f8": "float64 f8 double", "b1": "bool b1 bool_ boolean", "str": "string str char object o s u vlen_str",
}
LOGICAL = {name: logical for logical, names in SPELLINGS.items() for name in names.split()}
SQL_TYPE = {"b1": T.BooleanType(), "i1": T.ByteType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "i8": T.LongType(), "u8": T.DecimalType(20, 0), "f4": T.FloatType(), "f8": T.DoubleType(), "str": T.StringType()}
FLAG = "ascending_flag"
CHANGE = "stream string, file_name string, field_name string, change_kind string, old string, new string, place int"
CHANGE_ARROW = pa.schema([*((c, pa.string()) for c in ("stream", "file_name", "field_name", "change_kind", "old", "new")), ("place", pa.int32())])
COLUMNS_AT_MOST = 10_000
START = r"(\d{8}T\d{6})"


def logical_type(spelling: object) -> str:
    """The logical type behind a spelling; byte order is no part of it.  Unknown spellings stay, in lower case."""
    s = re.sub(r"^[<>|=]", "", str(spelling or "").strip().lower())
    return LOGICAL.get(s) or ("str" if re.fullmatch(r"[su]\d+", s) else s)


def promote(a: str, b: str) -> str:
    """The smallest type of the lattice that holds both; ``str`` is its top.

    Commutative, associative and idempotent: sizes widen, signed with unsigned takes the next signed size, integers
    with a float take the float that holds them exactly (f8 from 32 bits on), everything else is text."""
    if a == b:
        return a
    kinds = {a[:1], b[:1]}
    if "str" in (a, b) or not {a, b} <= set(SQL_TYPE):
        return "str"
    if kinds == {"b", "b"} or "b" in kinds:
        other = a if b == "b1" else b
        return other
    size = {x: int(x[1:]) for x in (a, b)}
    if "f" in kinds:
        whole = [x for x in (a, b) if x[0] != "f"]
        return "f8" if "f8" in (a, b) or any(size[x] >= 4 for x in whole) else "f4"
    if len(kinds) == 1:
        return a if size[a] > size[b] else b
    signed, unsigned = (a, b) if a[0] == "i" else (b, a)
    need = max(size[signed], size[unsigned] * 2)
    return f"i{need}" if need <= 8 else "f8"


def join_types(types: Iterable[str]) -> str:
    """Fold of ``promote`` that does not depend on the order: u4 with i4 and f4 is f8, whichever comes first."""
    seen = sorted(set(types))
    out = reduce(promote, seen)
    return "f8" if out == "f4" and any(t[0] in "iu" and int(t[1:]) >= 4 for t in seen if t in SQL_TYPE and t != "str") else out


def parse_header(text: str | None) -> dict | None:
    """``{"format", "flag", "vars": {name: [type, key of long_name, long_name]}}`` of a JSON header, or None if it is no
    JSON object.  Variables may come as a mapping or as a list; order and layout don't matter."""
    try:
        h = json.loads(text)
        raw = h.get("variables") or {}
        items = [(v.get("name"), v) for v in raw] if isinstance(raw, list) else list(raw.items())
        variables = {}
        for name, v in items:
            if name is not None:
                v = v if isinstance(v, dict) else {"dtype": v}
                long_name = v.get("long_name") or ""
                variables[str(name)] = [logical_type(v.get("dtype")), "".join(str(long_name).lower().split()), long_name]
        flags = sorted(k for k in (h.get("attrs") or {}) if k.lower().rsplit(":", 1)[-1] == FLAG)
        return {"format": None if h.get("file_format") is None else str(h["file_format"]).strip(), "flag": flags, "vars": variables}
    except (ValueError, AttributeError, TypeError):
        return None


def differences(old: dict, new: dict) -> list[tuple[str, str, str | None, str | None]]:
    """(field, change, old, new) between two parsed headers, in a fixed order."""
    out = []
    a, b = old["vars"], new["vars"]
    gone, come = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    by_key: dict[str, list[str]] = {}
    for name in gone:
        if a[name][1]:
            by_key.setdefault(a[name][1], []).append(name)
    origin = {name: name for name in set(a) & set(b)}
    for name in come:
        if by_key.get(b[name][1]):
            origin[name] = by_key[b[name][1]].pop(0)
            gone.remove(origin[name])
            out.append((name, "renamed", origin[name], name))
        else:
            out.append((name, "added", None, b[name][0]))
    out += [(name, "removed", a[name][0], None) for name in gone]
    out += [(name, "retyped", a[was][0], b[name][0]) for name, was in sorted(origin.items()) if a[was][0] != b[name][0]]
    lost, found = [k for k in old["flag"] if k not in new["flag"]], [k for k in new["flag"] if k not in old["flag"]]
    while lost and found:
        was, now = lost.pop(0), found.pop(0)
        out.append((now, "renamed", was, now))
    out += [(k, "added", None, "attribute") for k in found] + [(k, "removed", "attribute", None) for k in lost]
    if old["format"] != new["format"]:
        out.append(("file_format", "retyped", old["format"], new["format"]))
    return out


def _changes(stream: str, name: str, old: dict, new: dict) -> list[tuple]:
    return [(stream, name, *d, place) for place, d in enumerate(differences(old, new), 1)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours within the partition; the first file of its first stream and the last of its last go out whole."""
    rows, before = [], None
    first = None
    for batch in batches:
        for stream, name, header in zip(*(batch.column(c).to_pylist() for c in ("stream", "file_name", "header")), strict=True):
            if before and before[:2] == (stream, name):
                continue
            parsed = parse_header(header)
            if parsed is None:
                continue
            here = (stream, name, parsed)
            if before and before[0] == stream:
                rows += _changes(stream, name, before[2], parsed)
            first, before = first or here, here
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(CHANGE_ARROW.names, r, strict=True)) for r in rows], CHANGE_ARROW)
            rows = []
    if before:
        ends = [(before, "tail")] if first[:2] != before[:2] else []
        out = [(*x[:2], None, "only" if not ends else role, json.dumps(x[2]), None, None) for x, role in [(first, "head"), *ends]]
        yield pa.RecordBatch.from_pylist([dict(zip(CHANGE_ARROW.names, r, strict=True)) for r in out], CHANGE_ARROW)


def _stitch(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    rows.sort(key=lambda r: (re.search(START, r["file_name"])[1], r["file_name"]))
    out = []
    for a, b in zip(rows, rows[1:], strict=False):
        if a["change_kind"] != "head" and b["change_kind"] != "tail":
            out += _changes(b["stream"], b["file_name"], json.loads(a["old"]), json.loads(b["old"]))
    return pa.Table.from_pylist([dict(zip(CHANGE_ARROW.names, r, strict=True)) for r in out], CHANGE_ARROW)


def drift_report(headers: DataFrame) -> DataFrame:
    """Every change between a file and the stream's previous file by sensing start (the first ``yyyymmddThhmmss`` of its
    name): ``stream, start, file_name, place, field_name, change_kind, old, new``; in the order of (stream, start, file_name,
    place) they are the stream's log.

    ``change_kind`` is added, removed, renamed (same long_name but for case and blanks; ``field_name`` is the new name)
    or retyped (another logical type, or ``file_format``).  A repeated file counts once, as delivered first; equal
    starts are ordered by name.  Rows with a NULL stream, a name without a start or an unreadable header are left out,
    their neighbours are compared with each other.  Attribute values make no change.  An empty table gives none.
    """
    ordered = headers.where(F.col("stream").isNotNull()).select(
        "stream", F.regexp_extract("file_name", START, 1).alias("start"), "file_name", "delivered_at", "header_id", "header"
    ).where("start <> ''")
    # repeated files fall together before the shuffle, however many there are
    ordered = ordered.groupBy("stream", "start", "file_name").agg(F.min_by("header", F.struct("delivered_at", "header_id")).alias("header"))
    ordered = ordered.repartitionByRange("stream", "start", "file_name").sortWithinPartitions("stream", "start", "file_name")
    passed = cut(ordered.select("stream", "file_name", "header").mapInArrow(_compare, CHANGE), "drift-pass")
    at_cuts = passed.where("field_name IS NULL").groupBy("stream").applyInArrow(_stitch, CHANGE)
    log = passed.where("field_name IS NOT NULL").unionByName(at_cuts).withColumn("start", F.try_to_timestamp(F.regexp_extract("file_name", START, 1), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz"))
    return log.select("stream", "start", "file_name", "place", "field_name", "change_kind", "old", "new")


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = set()
        for stream, header in zip(batch.column("stream").to_pylist(), batch.column("header").to_pylist(), strict=True):
            for name, (kind, key, _) in ((parse_header(header) or {}).get("vars") or {}).items():
                out.add((stream, key or name, name, kind))
        cols = list(zip(*sorted(out, key=str), strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["stream", "field_key", "name", "kind"])


def union_schema(headers: DataFrame) -> DataFrame:
    """One row per (stream, field): ``field_key`` (normalised long_name, or the name where that is missing), the
    canonical ``field_name`` (smallest of its names), all ``names`` and the promoted ``kind``.  The fold runs over
    distinct (name, type) pairs, of which a stream has few."""
    pairs = headers.where("stream IS NOT NULL").select("stream", "header").mapInArrow(_fields, "stream string, field_key string, name string, kind string").distinct()

    @F.pandas_udf("string")
    def fold(kinds: pd.Series) -> pd.Series:
        return kinds.map(join_types)

    return (
        pairs.groupBy("stream", "field_key")
        .agg(F.min("name").alias("field_name"), F.sort_array(F.collect_set("name")).alias("names"), F.collect_set("kind").alias("kinds"))
        .select("stream", "field_key", "field_name", "names", fold("kinds").alias("kind"))
    )


def _typed(kind: Column, text: Column) -> dict[str, Column]:
    """The text of a field as its promoted kind: ``flag``, ``whole`` (exact) and ``number``, each where the kind has it."""
    digits = F.when(F.lower(F.trim(text)) == "true", "1").when(F.lower(F.trim(text)) == "false", "0").otherwise(text)
    exact = digits.try_cast("decimal(38,10)")
    wholes = [F.when((kind == k) & (exact == F.floor(exact)), F.floor(exact).try_cast(t).cast("decimal(20,0)")) for k, t in SQL_TYPE.items() if k[0] in "iu"]
    return {"number": F.when(~kind.isin("str", "b1"), digits.try_cast("double")), "flag": F.when(kind == "b1", text.try_cast("boolean")), "whole": F.coalesce(*wholes)}


def unified_records(headers: DataFrame) -> DataFrame:
    """All records in one consistent long table: ``header_id, stream, file_name, field_name, kind, text, number, flag,
    whole, readable``.

    Every field of the stream appears under its canonical name and promoted type, NULL where the file's record has no
    such field; fields that no header names come as text.  ``text`` always holds the plain form, ``flag`` the value of a
    b1, ``whole`` that of an integer kind without loss (NULL if it doesn't fit), ``number`` that of every number as
    double; text that is none of its kind becomes NULL there.  A stream has one schema, whatever its files say; a
    repeated file is kept once (first delivery with a record).  ``readable`` is false where the record is missing or no
    JSON object; all fields are NULL then, and a stream without any field has one row without field_name."""
    union = union_schema(headers)
    schema = union.select("stream", F.explode("names").alias("name"), "field_name", "kind")
    fields = union.groupBy("stream").agg(F.collect_list(F.struct("field_name", "names")).alias("fields"))
    order = F.struct(F.col("record_json").isNull(), "delivered_at", "header_id")
    one = headers.where("stream IS NOT NULL").groupBy("stream", "file_name").agg(F.min_by(F.struct("header_id", "record_json"), order).alias("r")).join(fields, "stream", "left")
    one = one.withColumn("record", F.from_json("r.record_json", T.MapType(T.StringType(), T.StringType())))
    names, cell = F.coalesce(F.map_keys("record"), F.array().cast("array<string>")), "array<struct<name:string,text:string>>"
    lacking = F.transform(F.filter("fields", lambda f: ~F.arrays_overlap(f["names"], names)), lambda f: F.struct(f["field_name"].alias("name"), F.lit(None).cast("string").alias("text")))
    every = F.concat(*(F.coalesce(c, F.array()).cast(cell) for c in (F.map_entries("record"), lacking)))
    cells = one.select("r.header_id", "stream", "file_name", F.col("record").isNotNull().alias("readable"), F.inline_outer(every))
    known = cells.join(schema, ["stream", "name"], "left").withColumn("kind", F.coalesce("kind", F.lit("str")))
    return known.select("header_id", "stream", "file_name", F.coalesce("field_name", "name").alias("field_name"), "kind", "text", *(c.alias(n) for n, c in _typed(F.col("kind"), F.col("text")).items()), "readable")


def unified_table(headers: DataFrame) -> DataFrame:
    """All records in one wide table: ``header_id, stream, file_name, readable`` and a column for every field of any stream,
    in the promoted type over all streams; a field that is called like one of the four gets ``_field`` behind its name.

    Whole numbers keep all their digits (LONG, or DECIMAL(20,0) for u8), flags are BOOLEAN; what does not fit its column's type
    is NULL there (``unified_records`` has its text).  The columns are metadata of the driver; more than 10,000 are refused."""
    fields = union_schema(headers).groupBy("field_name").agg(F.collect_set("kind").alias("kinds")).limit(COLUMNS_AT_MOST + 1).collect()
    if len(fields) > COLUMNS_AT_MOST:
        raise EngineError(f"more than {COLUMNS_AT_MOST} fields")
    keys = ["header_id", "stream", "file_name", "readable"]
    cells = unified_records(headers)
    columns = []
    for name, kinds in sorted((f.field_name, f.kinds) for f in fields):
        kind = join_types(kinds)
        source = "flag" if kind == "b1" else "number" if kind[0] == "f" else "whole" if kind in SQL_TYPE and kind != "str" else "text"
        columns.append(F.max(F.when(F.col("field_name") == name, F.col(source).cast(SQL_TYPE.get(kind, T.StringType())))).alias(name + "_field" * (name in keys)))
    return cells.groupBy(*keys).agg(*columns) if columns else cells.select(*keys).distinct()

"""Problems 2 and 4: compaction and schema drift."""

import json
import random
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loamline.operators.compaction import Conflict, SnapshotTable, compact, glob_regex, superfluous_files, template_regex
from loamline.operators.schema_drift import SQL_TYPE, differences, drift_report, join_types, logical_type, parse_header, promote, unified_records, unified_table, union_schema
from loamline.session import EngineError, work_path

FILES = "file_id long, reader_name string, path string, content string, table string"
READERS = "reader_name string, pattern string, fname_templ string, datetime_format string, target_bytes long"


def readers(spark):
    return spark.createDataFrame([("a", "**/*.nc", "img_{datetime}_V*.nc", "%Y%m%d%H%M", 100), ("b", "*/20[0-9][0-9]/*.nc", "sw_{datetime}.nc", "%Y_%j", 50), (None, "*", "*", "%Y", 1)], READERS)


@pytest.mark.parametrize("pattern,path,hit", [("**/*.nc", "x.nc", True), ("**/*.nc", "a/b/x.nc", True), ("*/20[0-9][0-9]/*.nc", "a/2014/x.nc", True), ("*/20[0-9][0-9]/*.nc", "a/2014/old/x.nc", False), ("**/S?_*.nc", "q/SM_1.nc", True), ("**/*.nc", "x.nc.tmp", False), ("a[!b].c", "aZ.c", True), ("a[!b].c", "ab.c", False)])
def test_glob(pattern, path, hit):
    import re

    assert bool(re.match(glob_regex(pattern), path)) == hit


def test_template_needs_a_time():
    import re

    r = template_regex("img_{datetime}_V*.nc", "%Y%m%dT%H%M")
    assert re.match(r, "img_20140101T0000_V1.0.nc") and not re.match(r, "img_2014_V1.0.nc")
    with pytest.raises(EngineError):
        template_regex("{datetime}", "%Q")


def sample(spark):
    rows = [
        (3, "a", "h/img_201401010000_V1.nc", "gpi,ssm,n\n1,2.0,3\n2,,1\n", "t"),
        (5, "a", "img_201401010000_V2.nc", "2,5,1\r\n1,7,1", "t"),  # all known
        (7, "a", "x/img_201401010000_V3.nc", "1,7,1\n9,NaN,1", "t"),  # 9 is new
        (8, "a", "x/img_201401020000_V3.nc", "gpi,ssm,n\n", "t"),  # no record
        (9, "a", "x/img_201413020000_V3.nc", "1,1,1", "t"),  # impossible time
        (10, "a", "x/img_201401010000_V3.nc.tmp", "77,1,1", "t"),
        (11, "b", "h/2014/sw_2014_001.nc", "1,1,1", "t"),
        (12, "b", "h/2014/sw_2014_001.nc", None, "t"),
        (13, "b", "h/2014/old/sw_2014_002.nc", "1,1,1", "t"),
        (14, "zz", "h/img_201401010000_V1.nc", "1,1,1", "t"),
        (15, "a", None, "1,1,1", "t"),
        (2, "a", "img_201402010000_V1.nc", "1,30.60,1\n1,4,4\n", "t"),
    ]
    return spark.createDataFrame(rows + rows[:2], FILES)


def test_superfluous(spark):
    assert {r.file_id for r in superfluous_files(sample(spark), readers(spark)).collect()} == {5, 8, 12}


def test_compacted_records(spark):
    table, plan = compact(sample(spark), readers(spark), work_path(spark, "t"))
    got = {(r.reader_name, str(r.image_time), r.gpi): (r.file_id, r.ssm) for r in table.read().collect()}
    assert len(got) == table.read().count() == 5
    assert got["a", "2014-01-01 00:00:00", 2] == (3, None) and got["a", "2014-02-01 00:00:00", 1] == (2, 30.6)
    assert table.version() == 1 and {r.reader_name for r in plan.collect()} == {"a", "b"}


def test_rewrite_is_partition_local_and_versioned(spark):
    root = work_path(spark, "t")
    compact(sample(spark), readers(spark), root)
    more = spark.createDataFrame([(20, "b", "h/2015/sw_2015_001.nc", "4,1,1", "t"), (21, "b", "h/2015/sw_2015_001.nc", "4,1,1", "t")], FILES)
    table, _ = compact(more, readers(spark), root)
    assert table.version() == 2
    assert {r.reader_name for r in table.read().select("reader_name").distinct().collect()} == {"a", "b"}
    assert table.read().where("reader_name = 'b'").count() == 1 and table.read().where("reader_name = 'a'").count() == 4


def test_conflicts(spark):
    root = work_path(spark, "t")
    table, _ = compact(sample(spark), readers(spark), root)
    rows = table.read()
    by = ["reader_name", "period"]
    with pytest.raises(Conflict):
        table.overwrite_partitions(rows, by, 0, lambda: True)
    with pytest.raises(Conflict):
        table.overwrite_partitions(rows, by, 1, lambda: False)
    table._write("v2.claim", {})
    with pytest.raises(Conflict):
        table.overwrite_partitions(rows, by, 1, lambda: True)
    assert SnapshotTable(spark, root).version() == 1 and rows.count() == 5
    table.release(2)
    assert table.overwrite_partitions(rows.where("reader_name = 'b'"), by, 1, lambda: True) == 2 and table.read().count() == 5
    assert table.read(1).count() == 5 and table.expire(1) == 0  # the first write still holds the other reader


def test_a_crash_before_publishing_leaves_the_table(spark, monkeypatch):
    root = work_path(spark, "t")
    compact(sample(spark), readers(spark), root)
    more = spark.createDataFrame([(20, "b", "h/2015/sw_2015_001.nc", "4,1,1", "t"), (21, "b", "h/2015/sw_2015_002.nc", "5,1,1", "t")], FILES)

    def crash(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_publish", crash)
        m.setattr(SnapshotTable, "_delete", lambda *_: None)  # nor does it clean up
        with pytest.raises(RuntimeError):
            compact(more, readers(spark), root)
    table = SnapshotTable(spark, root)
    assert table.version() == 1 and {r.file_id for r in table.read().where("reader_name = 'b'").collect()} == {11}
    table.release(2)
    compact(more, readers(spark), root)
    assert {r.file_id for r in table.read().where("reader_name = 'b'").collect()} == {20, 21}
    assert table.expire(1) == 1 and table.read().count() == 6


def test_deliveries_during_the_rewrite_are_a_conflict(spark):
    """Also two equal rows, which an exclusive or would not notice."""
    root = work_path(spark, "t")
    late = spark.createDataFrame([(30, "a", "h/img_201401010000_V9.nc", "50,1,1", "t")] * 2, FILES)
    calls = []

    def source():
        calls.append(1)
        return sample(spark) if len(calls) == 1 else sample(spark).unionByName(late)

    with pytest.raises(Conflict):
        compact(source, readers(spark), root)
    assert len(calls) == 2 and SnapshotTable(spark, root).version() == 0


def test_only_changed_partitions_are_written_again(spark):
    root = work_path(spark, "t")
    compact(sample(spark), readers(spark), root)
    table, plan = compact(sample(spark), readers(spark), root)
    assert table.version() == 1 and plan.where("rewrite").count() == 0
    more = sample(spark).unionByName(spark.createDataFrame([(31, "b", "h/2014/sw_2014_009.nc", "8,1,1", "t")], FILES))
    table, plan = compact(more, readers(spark), root)
    assert table.version() == 2 and [r.reader_name for r in plan.where("rewrite").collect()] == ["b"] and table.read().count() == 6


def test_large_readers_are_cut_into_years_and_keep_them(spark):
    """Years are partitions of their own; a new file rewrites its year only, and files come near their target size."""
    rnd = random.Random(2)

    def file(i, year, day):
        return (i, "y", f"y_{year}{day:02d}.nc", "\n".join(f"{g},{rnd.random():.3f},{rnd.random():.3f}" for g in range(day * 1000, day * 1000 + 600)), "t")

    rule = spark.createDataFrame([("y", "*", "y_{datetime}.nc", "%Y%d", 20_000)], READERS)
    rows = [file(100 * y + d, y, d) for y in (2014, 2015, 2016) for d in range(1, 29)]
    root = work_path(spark, "t")
    table, plan = compact(spark.createDataFrame(rows, FILES), rule, root)
    assert {r.period for r in plan.collect()} == {"2014", "2015", "2016"} and table.read().count() == len(rows) * 600
    sizes = [f.getLen() for f in table._fs.globStatus(table._path(f"{root}/data/*/*/*/*.parquet"))]
    assert len(sizes) < len(rows) / 2 and all(10_000 <= n <= 30_000 for n in sizes)
    table, plan = compact(spark.createDataFrame([*rows, file(7, 2015, 30)], FILES), rule, root)
    assert [r.period for r in plan.where("rewrite").collect()] == ["2015"] and table.read().count() == (len(rows) + 1) * 600
    assert len({e["write"] for e in table.manifest()["partitions"].values()}) == 2


def test_compaction_empty(spark):
    empty = spark.createDataFrame([], FILES)
    table, plan = compact(empty, readers(spark), work_path(spark, "t"))
    assert table.version() == 0 and plan.count() == 0 and superfluous_files(empty, readers(spark)).count() == 0


# --- drift --------------------------------------------------------------------------------------------------------

HEADERS = "header_id long, stream string, file_name string, delivered_at timestamp_ntz, header string, record_json string, kind string"
TYPES = sorted(SQL_TYPE)


@given(st.sampled_from(TYPES), st.sampled_from(TYPES))
def test_promote_is_a_join(a, b):
    assert promote(a, b) == promote(b, a) and promote(a, a) == a and promote(promote(a, b), a) == promote(a, b)


@given(st.lists(st.sampled_from(TYPES), min_size=1, max_size=6), st.randoms())
def test_fold_ignores_order(types, rnd):
    mixed = list(types)
    rnd.shuffle(mixed)
    assert join_types(types) == join_types(mixed)


@pytest.mark.parametrize("a,b", [("float32", "<f4"), ("float", ">f4"), ("short", "int16"), ("ubyte", "|u1"), ("string", "<U12"), ("char", "str"), ("double", "float64"), ("int", "<i4")])
def test_spellings(a, b):
    assert logical_type(a) == logical_type(b)


def header(variables, fmt="NETCDF4", flag="VH:Ascending_Flag", listed=False):
    v = {n: {"dtype": t, "long_name": long} for n, (t, long) in variables.items()}
    return json.dumps({"file_format": fmt, "attrs": {flag: "A", "P": "1"} if flag else {}, "variables": [{"name": n, **x} for n, x in v.items()] if listed else v})


def test_differences():
    old = parse_header(header({"A": ("f4", "Soil  water"), "B": ("i2", "b"), "C": ("i2", "c"), "D": ("i2", "")}))
    new = parse_header(header({"A2": ("float64", "SOIL WATER "), "B": ("int", "b"), "E": ("i2", "")}, "NETCDF3", "Full:Ascending_Flag", True))
    assert {d[:2] for d in differences(old, new)} == {("A2", "renamed"), ("A2", "retyped"), ("B", "retyped"), ("C", "removed"), ("D", "removed"), ("E", "added"), ("file_format", "retyped"), ("Full:Ascending_Flag", "renamed")}
    assert parse_header("{nonsense") is None and parse_header(None) is None and parse_header("[]") is None


def test_report_however_the_stream_is_cut(spark, partitions):
    rnd = random.Random(4)
    rows, expected = [], set()
    for stream in ("hot", "s1", "s2"):
        before = None
        for i in range(90 if stream == "hot" else 4):
            names = {n: (rnd.choice(("f4", "i2")), n.lower()) for n in rnd.sample("ABCDEF", 4)}
            name = f"SM_2013{i // 28 + 1:02d}{i % 28 + 1:02d}T000000_x.nc"
            parsed = parse_header(header(names))
            if before:
                expected |= {(stream, name, d[0], d[1]) for d in differences(before, parsed)}
            before = parsed
            rows.append((len(rows), stream, name, None, header(names, listed=i % 2 == 0), "{}", "k"))
    rows += rows[:10] + [(900, None, "SM_20130101T000000", None, header({}), "{}", "k"), (901, "s1", "no start", None, header({}), "{}", "k"), (902, "s1", "SM_20130102T120000_x.nc", None, "broken", "{}", "k")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, HEADERS)
    for n in (1, 4, 13):
        partitions(n)
        got = [(r.stream, r.file_name, r.field_name, r.change_kind) for r in drift_report(df).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert drift_report(df.limit(0)).count() == 0


def test_unified_records(spark):
    a, b = header({"A": ("i2", "Water"), "T": ("str", "t")}), header({"a_v2": ("f4", "water"), "T": ("str", "t")})
    rows = [(1, "s", "SM_20130101T000000.nc", None, a, '{"A": 3, "T": "x"}', "k"), (2, "s", "SM_20130102T000000.nc", None, b, '{"a_v2": 0.5, "T": null}', "k"), (3, "s", "SM_20130102T000000.nc", None, b, '{"a_v2": 0.5}', "k")]
    df = spark.createDataFrame(rows, HEADERS)
    assert {(r.field_name, r.kind) for r in union_schema(df).collect()} == {("A", "f4"), ("T", "str")}
    got = {(r.header_id, r.field_name): (r.text, r.number) for r in unified_records(df).collect()}
    assert got == {(1, "A"): ("3", 3.0), (1, "T"): ("x", None), (2, "A"): ("0.5", 0.5), (2, "T"): (None, None)}


def test_unified_records_are_whole_and_typed(spark):
    def head(**kinds):
        return json.dumps({"file_format": "x", "attrs": {}, "variables": {n: {"dtype": k, "long_name": n} for n, k in kinds.items()}})

    big, day = 2**53 + 1, datetime(2020, 1, 1)
    rows = [
        (1, "s", "a", day, head(ok="bool", n="int64", m="uint64", x="float64"), f'{{"ok": true, "n": {big}, "m": {2**64 - 1}, "x": 1.5}}'),
        (2, "s", "b", day, head(ok="bool", n="int64"), '{"n": 7.5}'), (3, "s", "c", day, head(), "{broken"), (4, "s", "d", day, head(), "{}"), (5, "s", "e", day, head(), None), (6, "t", "f", day, head(), "no"),
    ]
    df = spark.createDataFrame(rows, "header_id long, stream string, file_name string, delivered_at timestamp_ntz, header string, record_json string")
    got = unified_records(df).collect()
    by = {(r.header_id, r.field_name): r for r in got}
    assert len(by) == len(got) and set(by) == {(h, f) for h in range(1, 6) for f in ("ok", "n", "m", "x")} | {(6, None)}
    assert by[1, "ok"].flag is True and by[1, "n"].whole == big and by[1, "m"].whole == 2**64 - 1 and by[1, "x"].number == 1.5 and by[1, "x"].whole is None
    assert by[2, "n"].whole is None and by[2, "n"].number == 7.5 and by[2, "m"].text is None
    assert {h: by[h, "n" if h < 6 else None].readable for h in range(1, 7)} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_one_typed_table(spark):
    """A column per field over all streams, whole numbers beyond 2^53 with all digits, and the log in order."""
    def head(h, stream, day, variables, record):
        return (h, stream, f"SM_X_201501{day:02d}T000000_1.nc", datetime(2015, 1, day), json.dumps({"file_format": "A", "variables": variables}), json.dumps(record))

    rows = [
        head(1, "s", 1, {"n": {"dtype": "int64", "long_name": "count"}, "b": {"dtype": "bool"}, "u": {"dtype": "uint64"}}, {"n": 2**60 + 1, "b": True, "u": 2**64 - 1}),
        head(2, "s", 2, {"m": {"dtype": "int16", "long_name": "Count"}, "b": {"dtype": "bool"}, "v": {"dtype": "f4"}}, {"m": 7, "b": False, "v": 1.5}),
        head(3, "t", 3, {"v": {"dtype": "int32"}, "stream": {"dtype": "str"}}, {"v": 9, "stream": "x"}),
        head(4, "t", 4, {"v": {"dtype": "S4"}}, {}),
    ]
    df = spark.createDataFrame(rows, "header_id long, stream string, file_name string, delivered_at timestamp_ntz, header string, record_json string")
    table = unified_table(df)
    types = dict(table.dtypes)
    assert types["m"] == "bigint" and types["b"] == "boolean" and types["u"] == "decimal(20,0)" and types["v"] == "string" and types["stream_field"] == "string"
    by = {r.header_id: r for r in table.collect()}
    assert len(by) == 4 and by[1].m == 2**60 + 1 and int(by[1].u) == 2**64 - 1 and by[1].b is True and by[2].m == 7 and by[2].b is False and by[2].u is None
    assert by[3].v == "9" and by[3].stream_field == "x" and by[4].v is None
    log = [(r.stream, r.start.day, r.place, r.field_name, r.change_kind) for r in drift_report(df).orderBy("stream", "start", "file_name", "place").collect()]
    assert log == [("s", 2, 1, "m", "renamed"), ("s", 2, 2, "v", "added"), ("s", 2, 3, "u", "removed"), ("s", 2, 4, "m", "retyped"), ("t", 4, 1, "stream", "removed"), ("t", 4, 2, "v", "retyped")]
    assert unified_table(df.limit(0)).count() == 0

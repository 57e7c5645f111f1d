"""Coordinates and attributes of gridded files by their metadata, and attributes on the columns of a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from loamline.session import EngineError

#: Names and units by which coordinates are known.
NAMES = {"latitude": ["lat", "LAT"], "longitude": ["lon", "LON"]}
UNITS = {"latitude": r"degrees?_?n(orth)?", "longitude": r"degrees?_?e(ast)?"}
AXIS = {"latitude": "Lat", "longitude": "Lon", "time": "Time"}


def coordinate_of(variables: dict[str, dict], kind: str, alternatives: list[str] | None = None) -> str:
    """The variable that is the latitude or longitude: by standard_name, long_name (whole word), units or
    _CoordinateAxisType, else by name.  No candidate or several are an error."""
    word = rf"(?i)^\s*({kind[:3]}|{kind})\s*$"
    found = [
        n for n, a in variables.items()
        if re.match(word, str(a.get("standard_name", ""))) or re.match(word, str(a.get("long_name", ""))) or re.fullmatch(UNITS.get(kind, "(?!)"), str(a.get("units", "")), re.I) or a.get("_CoordinateAxisType") == AXIS.get(kind)
    ]
    found = found or [n for n in (alternatives or NAMES.get(kind, [])) if n in variables][:1]
    if len(found) != 1:
        raise EngineError(f"{len(found)} variables look like the {kind}: {found}")
    return found[0]


def time_of(variables: dict[str, dict], dims: dict[str, list[str]], types: dict[str, str] | None = None) -> str:
    """The one-dimensional time variable: by attributes, else the only one-dimensional variable of a time type."""
    named = [n for n, a in variables.items() if len(dims.get(n, [])) == 1 and (str(a.get("standard_name", "")).lower() == "time" or a.get("axis") == "T" or a.get("_CoordinateAxisType") == "Time" or " since " in str(a.get("units", "")))]
    found = named or [n for n, t in (types or {}).items() if t.startswith("timestamp") and len(dims.get(n, ["x"])) == 1]
    if len(found) != 1:
        raise EngineError(f"{len(found)} variables look like the time: {found}")
    return found[0]


def yx_dims(dims: list[str]) -> tuple[str, str]:
    """(y, x) of two dimensions: by a letter x or y in their names, else in their order."""
    if len(dims) != 2:
        raise EngineError(f"two dimensions are needed, not {dims}")
    for i, d in enumerate(dims):
        if "x" in d.lower():
            return dims[1 - i], d
        if "y" in d.lower():
            return d, dims[1 - i]
    return dims[0], dims[1]


def with_time_axis(dims: list[str], known: tuple[str, ...]) -> list[str]:
    """Dimensions with a leading time axis: added where there is none; more than one unknown dimension is an error."""
    extra = [d for d in dims if d not in known]
    if len(extra) > 1:
        raise EngineError(f"unexpected dimensions {extra}")
    return dims if extra else ["time", *dims]


#: CF attributes of coordinates.
COORDINATES = {
    "lat": {"standard_name": "latitude", "long_name": "latitude", "units": "degrees_north", "axis": "Y", "valid_min": -90.0, "valid_max": 90.0},
    "lon": {"standard_name": "longitude", "long_name": "longitude", "units": "degrees_east", "axis": "X", "valid_min": -180.0, "valid_max": 180.0},
    "time": {"standard_name": "time", "long_name": "time", "axis": "T"},
}
BOOKKEEPING = ("row_size", "location_id", "location_description")


def merged_attributes(found: dict[str, dict], added: dict[str, dict] | None = None, discard: bool = False) -> dict[str, dict]:
    """Attributes by variable: those of the file (unless discarded), overridden by the given ones."""
    out = {} if discard else {n: dict(a) for n, a in found.items()}
    for n, a in (added or {}).items():
        out.setdefault(n, {}).update(a)
    return out


def with_attributes(df: DataFrame, added: dict[str, dict] | None = None, discard: bool = False, coordinates: bool = True) -> DataFrame:
    """A table whose columns carry attributes as metadata: those they have (unless discarded), overridden by ``added``; lat,
    lon and time get their CF attributes.  Parquet keeps them."""
    given = merged_attributes(attributes_of(df), added, discard)
    for name, known in COORDINATES.items():
        if coordinates and name in df.columns:
            given[name] = known | given.get(name, {})
    for name in df.columns:
        if given.get(name) or df.schema[name].metadata:
            df = df.withMetadata(name, given.get(name, {}))
    return df


def attributes_of(df: DataFrame) -> dict[str, dict]:
    """The attributes of each column that has some."""
    return {f.name: dict(f.metadata) for f in df.schema.fields if f.metadata}


def types_of(df: DataFrame) -> dict[str, str]:
    """The type of each column."""
    return dict(df.dtypes)


def description(variables: dict[str, dict]) -> list[tuple[str, dict]]:
    """(name, attributes) of the data variables, without the bookkeeping of series files."""
    return [(n, a) for n, a in sorted(variables.items()) if n not in BOOKKEEPING]


def variable_description(df: DataFrame) -> DataFrame:
    """(variable, type, attributes) of a table's data variables, attributes as a map of text."""
    found = attributes_of(df)
    rows = [(n, t, {k: str(v) for k, v in found.get(n, {}).items()}) for n, t in df.dtypes if n not in (*BOOKKEEPING, *COORDINATES, "gpi", "cell", "row", "col")]
    return df.sparkSession.createDataFrame(rows, "variable string, type string, attributes map<string,string>")

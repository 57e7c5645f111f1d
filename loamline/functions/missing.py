"""Missing values: NaN and fill values become NULL once, at the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(value: Column, *fills: float) -> Column:
    """``value`` with NaN and each of ``fills`` turned into NULL.  NULL stays NULL."""
    bad = F.isnan(value)
    for fill in fills:
        bad = bad | (value == F.lit(float(fill)))
    return F.when(value.isNotNull() & ~bad, value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every FLOAT/DOUBLE column with NaN as NULL; other columns and an empty table pass unchanged."""
    return df.select(
        *(
            F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.FloatType | T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        )
    )

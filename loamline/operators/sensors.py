"""Classification of in-situ sensors by their triple-collocation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.missing import present
from loamline.session import EngineError

#: The class and criterion labels.
VERY, SOME, NOT, UNKNOWN = "very representative", "representative", "not representative", "undeducible"
OK, WIDE, FEW, OTHER = "ok", "large CI range", "low nobs", "other"


def classify(df: DataFrame, snr: str = "snr", nobs: str = "nobs", ci_lower: str | None = "ci_lower", ci_upper: str | None = "ci_upper", min_nobs: int = 100, thresholds: tuple[float, float] = (0, 3), ci_delta: float = 3) -> DataFrame:
    """Adds ``delta_ci``, ``frm_class`` and ``criterion``.

    Missing numbers (NULL, NaN) fail every comparison, so a sensor without a ratio is undeducible.  A wide confidence
    interval names the criterion before few observations.  Both interval columns or none must be given.
    """
    if (ci_lower is None) != (ci_upper is None):
        raise EngineError("give both bounds of the confidence interval or none")
    delta = present(F.col(ci_upper)) - present(F.col(ci_lower)) if ci_lower else F.lit(None).cast("double")
    ratio, n = present(F.col(snr).cast("double")), present(F.col(nobs).cast("double"))
    low, wide = F.coalesce(n < min_nobs, F.lit(False)), F.coalesce(delta > ci_delta, F.lit(False))
    good = ~low & ~wide & ratio.isNotNull()
    frm = F.when(good & (ratio >= thresholds[1]), VERY).when(good & (ratio >= thresholds[0]), SOME).when(good, NOT).otherwise(UNKNOWN)
    criterion = F.when(good, OK).when(wide, WIDE).when(low, FEW).otherwise(OTHER)
    return df.withColumns({"delta_ci": delta, "frm_class": frm, "criterion": criterion})


def class_counts(classified: DataFrame) -> DataFrame:
    """Sensors by class and criterion."""
    return classified.groupBy("frm_class", "criterion").agg(F.count(F.lit(1)).alias("n"))


def labelled(classified: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The exported table: a constant ``variable``, without coordinates and index unless kept."""
    drop = [c for c in ("lon", "lat", "idx") if c in classified.columns and c not in keep]
    return classified.drop(*drop).withColumn("variable", F.lit("soil_moisture"))


#: The columns of a sensor and what they are called in a result unless the caller says otherwise.
RESULT_FIELDS = {"snr": "snr", "nobs": "n_obs", "ci_lower": "snr_ci_lower", "ci_upper": "snr_ci_upper", "depth_from": "depth_from", "depth_to": "depth_to", "network": "network", "station": "station", "instrument": "instrument"}


def collocation_results(results: DataFrame, fields: dict[str, str] | None = None, others: tuple[str, ...] = ()) -> DataFrame:
    """A triple-collocation result as sensors: idx, lat, lon (where it has them), the columns of ``fields`` (column: name in the
    result), and ``others`` as they are.  Bytes become text, NaN is NULL; a result without the ratio or the number of
    observations is refused, other fields that are missing are NULL."""
    names = RESULT_FIELDS | (fields or {})
    lost = [names[c] for c in ("snr", "nobs") if names[c] not in results.columns]
    if lost:
        raise EngineError(f"the result has no {lost}")
    kinds = dict(results.dtypes)

    def field(column: str) -> Column:
        name, text = names[column], column in ("network", "station", "instrument")
        if name not in kinds:
            return F.lit(None).cast("string" if text else "double").alias(column)
        value = F.col(f"`{name}`")
        return (F.trim(F.decode(value, "UTF-8") if kinds[name] == "binary" else value.cast("string")) if text else present(value.cast("double"))).alias(column)

    places = [c for c in ("idx", "lat", "lon") if c in kinds]
    return results.select(*places, *(field(c) for c in RESULT_FIELDS), *(F.col(f"`{c}`") for c in others))


def qualified(results: DataFrame, fields: dict[str, str] | None = None, others: tuple[str, ...] = (), **limits) -> DataFrame:
    """From a triple-collocation result to the classified sensors of an export: one row per sensor with its class and criterion.
    A result without both bounds of the interval is classified without them."""
    names = RESULT_FIELDS | (fields or {})
    bounds = all(names[c] in results.columns for c in ("ci_lower", "ci_upper"))
    sensors = collocation_results(results, fields, others)
    return classify(sensors, ci_lower="ci_lower" if bounds else None, ci_upper="ci_upper" if bounds else None, **limits)

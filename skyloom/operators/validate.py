"""Projection, range validation and redshift policies of a curated catalog."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from skyloom.functions.expr import (
    DEC_MAX_DEG,
    DEC_MIN_DEG,
    INVALID_Z,
    RA_MAX_DEG,
    RA_MIN_DEG,
    CatalogError,
    clean,
    col,
    is_float,
    is_numeric,
    number_from_text,
    ordered_unique,
    require_columns,
    type_of,
    valid_z,
    z_range,
)
from skyloom.operators.transforms import generated_columns, input_columns

# Comparison operators a redshift filter may name.
_OPERATORS = ("<", "<=", ">", ">=", "==", "!=")


def strict_number(df: DataFrame, name: str) -> Column:
    """Double view for validation: text must hold numbers, anything else is an error."""
    dtype = type_of(df, name)
    if isinstance(dtype, T.StringType):
        text = F.trim(col(name))
        value = number_from_text(text)
        message = F.concat(F.lit(f"Column '{name}' must be numeric, found: "), text)
        value = F.when(value.isNull() & text.isNotNull(), F.raise_error(message).cast("double")).otherwise(value)
        return F.when(~F.isnan(value), value)
    if not is_numeric(dtype) and not isinstance(dtype, T.BooleanType):
        raise CatalogError(f"Column '{name}' must be numeric to be validated.")
    return clean(col(name), dtype).cast("double")


def _comparable(df: DataFrame, name: str) -> Column:
    """Value for two-sided range tests, which NaN fails by itself, so doubles stay bare columns.

    A bare column keeps the expression small when a filter is pushed through the
    projection that made it, and reaches the Parquet scan when it is a source column.
    """
    return col(name) if is_float(type_of(df, name)) else strict_number(df, name)


def required_inputs(
    selection: Sequence[str], transformations: Sequence[dict[str, Any]], standard: Sequence[str]
) -> list[str] | None:
    """Source columns a spec needs, or None when it keeps every column.

    A column that one transformation generates and a later one reads is no input.
    """
    if not selection:
        return None
    made: set[str] = set()
    needed: list[str] = []
    for spec in transformations:
        needed += [name for name in input_columns(spec) if name not in made]
        made.update(generated_columns(spec))
    return ordered_unique([n for n in [*selection, *standard] if n not in made] + needed)


def final_columns(
    columns: Sequence[str],
    selection: Sequence[str],
    generated: Sequence[str],
    standard: Sequence[str],
    position: str = "last",
) -> list[str]:
    """Output columns: the selection in its order, other generated columns first or last.

    Without a selection all columns stay, the generated ones at their end of the table.
    """
    wanted = list(selection) or [n for n in columns if n not in set(generated)]
    made = [n for n in generated if n not in set(wanted)]
    faults = {
        "generated columns can stand first or last, not " + position: position not in ("first", "last"),
        "it selects columns that do not exist": sorted(set(wanted) - set(columns), key=wanted.index),
        "it leaves out standard columns": [n for n in standard if selection and n not in selection],
    }
    for fault, found in faults.items():
        if found:
            names = f": {', '.join(found)}" if isinstance(found, list) else ""
            raise CatalogError(f"The output cannot be laid out, {fault}{names}.")
    return made + wanted if position == "first" else wanted + made


def range_metrics(df: DataFrame, ra: str, dec: str, z: str, allow_blueshifts: bool = True) -> list[Column]:
    """Aggregates behind the validation of the three standard columns (missing redshifts are invalid)."""
    values = {"ra": strict_number(df, ra), "dec": strict_number(df, dec), "z": strict_number(df, z)}
    metrics = [f(v).alias(f"{k}_{n}") for k, v in values.items() for n, f in (("min", F.min), ("max", F.max))]
    invalid = ~F.coalesce(valid_z(_comparable(df, z), allow_blueshifts), F.lit(False))
    return metrics + [F.count_if(invalid).alias("invalid_redshift_count")]


def standard_ranges(df: DataFrame, ra: str, dec: str, z: str, allow_blueshifts: bool = True) -> DataFrame:
    """One row: observed ranges of RA, Dec and z and the number of invalid redshifts."""
    require_columns(df, [ra, dec, z], "validation")
    return df.agg(*range_metrics(df, ra, dec, z, allow_blueshifts))


def check_ranges(row: dict[str, Any], ra: str, dec: str, z: str, policy: str, allow_blueshifts: bool) -> None:
    """Raise on the first range an observed ``standard_ranges`` row breaks; all-missing columns pass."""
    hint = "Convert it to degrees with a transformation and name the result in coordinates."

    def observed(key: str) -> str:
        return f"Observed range: [{row[key + '_min']}, {row[key + '_max']}]."

    if row["ra_min"] is not None and (row["ra_min"] < RA_MIN_DEG or row["ra_max"] >= RA_MAX_DEG):
        raise CatalogError(
            f"RA column '{ra}' is outside the required range [{RA_MIN_DEG}, {RA_MAX_DEG}). {observed('ra')} {hint}"
        )
    if row["dec_min"] is not None and (row["dec_min"] <= DEC_MIN_DEG or row["dec_max"] >= DEC_MAX_DEG):
        raise CatalogError(
            f"DEC column '{dec}' is outside the required range ({DEC_MIN_DEG}, {DEC_MAX_DEG}). {observed('dec')} {hint}"
        )
    if row["invalid_redshift_count"] and policy == "fail":
        low, high = z_range(allow_blueshifts)
        raise CatalogError(
            f"Redshift column '{z}' is outside the required range ({low}, {high}). {observed('z')} "
            "The policies flag and keep let such rows pass."
        )


def coordinate_violations(df: DataFrame, ra: str, dec: str) -> DataFrame:
    """Rows whose RA is not in [0, 360) or whose Dec is not in (-90, 90); missing values pass."""
    r, d = strict_number(df, ra), strict_number(df, dec)
    bad_ra = (r < RA_MIN_DEG) | (r >= RA_MAX_DEG)
    bad_dec = (d <= DEC_MIN_DEG) | (d >= DEC_MAX_DEG)
    return df.where(F.coalesce(bad_ra, F.lit(False)) | F.coalesce(bad_dec, F.lit(False)))


def redshift_violations(df: DataFrame, z: str, allow_blueshifts: bool = True) -> DataFrame:
    """Rows without a valid redshift."""
    return df.where(~F.coalesce(valid_z(_comparable(df, z), allow_blueshifts), F.lit(False)))


def flag_redshift(
    df: DataFrame, z: str, invalid_value: float = INVALID_Z, allow_blueshifts: bool = True
) -> DataFrame:
    """Invalid and missing redshifts become ``invalid_value``; single floats and decimals keep their type."""
    value = _comparable(df, z).cast("double")
    kept = F.when(valid_z(value, allow_blueshifts), value).otherwise(F.lit(float(invalid_value)))
    own = type_of(df, z)
    return df.withColumn(z, kept.cast(own) if isinstance(own, (T.FloatType, T.DecimalType)) else kept)


def filter_redshift(
    df: DataFrame, z: str, filters: Sequence[tuple[str, float]], allow_blueshifts: bool = True
) -> DataFrame:
    """Rows with a valid redshift that also pass every ``(operator, threshold)``."""
    if not filters:
        return df
    return df.where(redshift_interval(filters, allow_blueshifts).test(_comparable(df, z)))


@dataclass(frozen=True)
class Interval:
    """The redshifts a filter list keeps: one interval and the values it leaves out."""

    low: float
    low_open: bool
    high: float
    high_open: bool
    holes: tuple[float, ...]

    @property
    def empty(self) -> bool:
        return self.low > self.high

    def test(self, value: Column) -> Column:
        """True inside. A pushed filter evaluates a computed value at every mention, so there are few."""
        if self.empty:
            return F.lit(False)
        above = (value > F.lit(self.low)) if self.low_open else (value >= F.lit(self.low))
        below = (value < F.lit(self.high)) if self.high_open else (value <= F.lit(self.high))
        return above & below & ~value.isin(*self.holes) if self.holes else above & below


def redshift_interval(filters: Sequence[tuple[str, float]], allow_blueshifts: bool = True) -> Interval:
    """The valid range and all filters together."""
    low, high = z_range(allow_blueshifts)
    low_open, high_open, holes = True, True, []
    for op, threshold in filters:
        if op not in _OPERATORS:
            raise CatalogError(f"A redshift filter compares by one of {' '.join(_OPERATORS)}.")
        if isinstance(threshold, bool) or not isinstance(threshold, (int, float)):
            raise CatalogError("A redshift filter compares with a number.")
        t = float(threshold)
        if op in (">", ">=", "==") and (t > low or (t == low and op == ">")):
            low, low_open = t, op == ">"
        if op in ("<", "<=", "==") and (t < high or (t == high and op == "<")):
            high, high_open = t, op == "<"
        if op == "!=":
            holes.append(t)
        if op == "==" and not low <= t <= high:
            low, high = 1.0, 0.0
    return Interval(low, low_open, high, high_open, tuple(t for t in dict.fromkeys(holes) if low <= t <= high))


def spatial_metrics(df: DataFrame, ra: str, dec: str) -> list[Column]:
    """Aggregates behind the coordinate check of a spatial output."""
    absent = [n for n in (ra, dec) if n not in df.columns]
    if absent:
        raise CatalogError(f"Spatial output misses coordinate columns: {', '.join(absent)}.")
    aggs = []
    for key, name in (("ra", ra), ("dec", dec)):
        if not is_numeric(type_of(df, name)):
            raise CatalogError(f"Spatial output column '{name}' must be numeric.")
        value = clean(col(name), type_of(df, name)).cast("double")
        aggs += [
            F.count(value).alias(f"{key}_count"),
            F.min(value).alias(f"{key}_min"),
            F.max(value).alias(f"{key}_max"),
        ]
    return aggs


def spatial_coordinate_ranges(df: DataFrame, ra: str, dec: str) -> DataFrame:
    """One row: count, min and max of the coordinate columns of a spatial output."""
    return df.agg(*spatial_metrics(df, ra, dec))


def check_spatial_coordinates(row: dict[str, Any], ra: str, dec: str) -> None:
    """Refuse coordinates that cannot be placed on the sky."""
    if not row["ra_count"] or not row["dec_count"]:
        raise CatalogError("No row has both coordinates, so nothing can be placed on the sky.")
    if row["ra_min"] < RA_MIN_DEG or row["ra_max"] >= RA_MAX_DEG:
        raise CatalogError(f"RA column '{ra}' observed range: [{row['ra_min']}, {row['ra_max']}].")
    if row["dec_min"] <= DEC_MIN_DEG or row["dec_max"] >= DEC_MAX_DEG:
        raise CatalogError(f"Dec column '{dec}' observed range: [{row['dec_min']}, {row['dec_max']}].")


def observed(df: DataFrame, metrics: list[Column]) -> tuple[DataFrame, Callable[[], dict[str, Any]]]:
    """Attach aggregates to the next action on a frame; the returned call fetches their values.

    Where the optimizer proved the result empty and so never ran the scan, the
    call computes the aggregates itself. Only extremes and "more than zero"
    counts belong here: a task that runs again may add to a count twice.
    """
    seen = Observation()

    def values() -> dict[str, Any]:
        try:
            return seen.get
        except Py4JJavaError:  # the action ended without a metrics row
            return df.agg(*metrics).first().asDict()

    return df.observe(seen, *metrics), values

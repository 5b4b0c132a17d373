"""Exact quality aggregates: counts, diagnostics, histograms, value counts, descriptions, warnings.

Each is one partial/final aggregation; only the small result leaves the executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from skyloom.functions.expr import (
    as_number,
    clean,
    col,
    finite,
    is_numeric,
    missing,
    require_columns,
    type_of,
)
from skyloom.operators.facts import Facts, Lookup, table, tables
from skyloom.operators.quantiles import around, exact_quantiles, sketch


def missing_aggregates(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """The rows of a catalog and the missing values of some of its columns, under the keys every table knows them by."""
    counts = {f"missing {n}": F.count_if(missing(col(n), type_of(df, n))) for n in names}
    return {"rows": F.count(F.lit(1)), **counts}


def row_count_facts() -> Facts:
    return Facts({"rows": F.count(F.lit(1))}, lambda get: [F.struct(get("rows").alias("n_rows"))], "n_rows bigint")


def row_count(df: DataFrame) -> DataFrame:
    return table(df, row_count_facts())


def missing_facts(df: DataFrame, columns: Sequence[str] | None = None) -> Facts:
    names = list(columns or df.columns)
    require_columns(df, names, "missing_counts")

    def rows(get: Lookup) -> list[Column]:
        n = get("rows")
        return [
            F.struct(
                F.lit(name).alias("column"),
                get(f"missing {name}").alias("missing"),
                F.when(n > 0, get(f"missing {name}") * 100.0 / n).otherwise(F.lit(0.0)).alias("missing_pct"),
            )
            for name in names
        ]

    return Facts(missing_aggregates(df, names), rows, "column string, missing bigint, missing_pct double")


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, missing_pct) for every column; 0 percent of an empty catalog."""
    return table(df, missing_facts(df, columns))


def _diagnostic_counts(value: Column, value_range: Sequence[float] | None) -> tuple[Column, Column]:
    ok = finite(value)
    if value_range is None:
        return F.count_if(ok), F.count_if(ok)
    low, high = (F.lit(float(v)) for v in value_range)
    return F.count_if(ok), F.count_if(ok & (value >= low) & (value <= high))


def numeric_diagnostics(df: DataFrame, column: str, value_range: Sequence[float] | None = None) -> DataFrame:
    """Finite values, and those inside the closed range."""
    n_finite, n_inside = _diagnostic_counts(as_number(df, column), value_range)
    return df.agg(n_finite.alias("finite"), n_inside.alias("in_range"))


def _spatial_counts(ra: Column, dec: Column) -> dict[str, Column]:
    ok_ra, ok_dec = finite(ra), finite(dec)
    return {
        "nonfinite_ra": F.count_if(~ok_ra),
        "nonfinite_dec": F.count_if(~ok_dec),
        "ra_outside_range": F.count_if(ok_ra & ((ra < 0.0) | (ra >= 360.0))),
        "dec_outside_range": F.count_if(ok_dec & ((dec < -90.0) | (dec > 90.0))),
        "valid_pairs": F.count_if(ok_ra & ok_dec),
    }


def spatial_diagnostics(df: DataFrame, ra: str, dec: str) -> DataFrame:
    counts = _spatial_counts(as_number(df, ra), as_number(df, dec))
    return df.agg(*[c.alias(n) for n, c in counts.items()])


def numeric_range(df: DataFrame, column: str) -> DataFrame:
    value = as_number(df, column)
    return df.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def _edge(i: Column, low: float, high: float, bins: int) -> Column:
    """Edge ``i`` of ``bins`` equal bins, in the very arithmetic of an evenly spaced float grid."""
    step = (high - low) / bins
    return F.when(i >= bins, F.lit(high)).otherwise(i.cast("double") * F.lit(step) + F.lit(low))


def bin_index(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value: half-open bins, last one closed, NULL outside.

    The division may land one bin off next to an edge; comparing with the edges
    themselves repairs that, so the index is what a search in the edge list gives.
    """
    guess = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(float(bins))).cast("int")
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(bins - 1))
    fixed = (
        F.when(value < _edge(guess, low, high, bins), guess - 1)
        .when((guess < bins - 1) & (value >= _edge(guess + 1, low, high, bins)), guess + 1)
        .otherwise(guess)
    )
    return F.when((value >= F.lit(low)) & (value <= F.lit(high)), fixed)


def range_facts(df: DataFrame, columns: Sequence[str]) -> Facts:
    """(column, min_value, max_value) of each column."""
    aggregates = {}
    for name in columns:
        value = as_number(df, name)
        aggregates |= {f"least {name}": F.min(value), f"greatest {name}": F.max(value)}

    def rows(get: Lookup) -> list[Column]:
        return [
            F.struct(
                F.lit(name).alias("column"),
                get(f"least {name}").alias("min_value"),
                get(f"greatest {name}").alias("max_value"),
            )
            for name in columns
        ]

    return Facts(aggregates, rows, "column string, min_value double, max_value double")


def histogram_range(df: DataFrame, column: str, value_range: Sequence[float | None] | None = None) -> tuple[float, float]:
    """The range to bin: as given, else observed; (0, 1) if not finite, widened if a point."""
    if value_range is None:
        row = numeric_range(df, column).first()
        value_range = (row["min_value"], row["max_value"])
    low, high = value_range
    if low is None or high is None or not (math.isfinite(low) and math.isfinite(high)):
        return 0.0, 1.0
    low, high = float(low), float(high)
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def histogram1d(
    df: DataFrame, column: str, bins: int = 50, value_range: Sequence[float] | None = None
) -> DataFrame:
    """(bin, lower, upper, n) for every bin, empty ones included."""
    low, high = histogram_range(df, column, value_range)
    value = as_number(df, column)
    binned = df.select(bin_index(value, low, high, bins).alias("bin")).where(F.col("bin").isNotNull())
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("k"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        _edge(F.col("bin"), low, high, bins).alias("lower"),
        _edge(F.col("bin") + 1, low, high, bins).alias("upper"),
        F.coalesce("k", F.lit(0)).cast("bigint").alias("n"),
    )


# Cells of the sky density grid, RA by Dec.
SKY_X_BINS = 179
SKY_Y_BINS = 89


def sky_x(ra: Column) -> Column:
    """Map longitude: RA 0 in the middle, growing to the left, in radians."""
    return -F.radians(F.pmod(ra + F.lit(180.0), F.lit(360.0)) - F.lit(180.0))


def histogram2d(
    df: DataFrame, ra: str, dec: str, x_bins: int = SKY_X_BINS, y_bins: int = SKY_Y_BINS
) -> DataFrame:
    """(ix, iy, n) of the occupied cells of the sky density grid."""
    r, d = as_number(df, ra), as_number(df, dec)
    x, y = sky_x(F.when(finite(r), r)), F.radians(F.when(finite(d), d))
    xy = df.select(x.alias("x"), y.alias("y"))
    cells = xy.select(
        bin_index(F.col("x"), -math.pi, math.pi, x_bins).alias("ix"),
        bin_index(F.col("y"), -math.pi / 2, math.pi / 2, y_bins).alias("iy"),
    )
    return (
        cells.where(F.col("ix").isNotNull() & F.col("iy").isNotNull())
        .groupBy("ix", "iy")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def value_counts(df: DataFrame, column: str, drop_missing: bool = False) -> DataFrame:
    """(value, n) sorted by value; missing is one value unless dropped."""
    keys = df.select(clean(col(column), type_of(df, column)).alias("value"))
    if drop_missing:
        keys = keys.where(F.col("value").isNotNull())
    return keys.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy("value")


# The quartiles of a description.
_QUARTILES = (0.25, 0.5, 0.75)
DESCRIBE_BATCH = 25
_MOMENTS = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
DESCRIPTION = (
    "column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
)


def described_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[list[str]]:
    """The numeric columns in batches, since each keeps a sketch in every task."""
    names = list(columns or [f.name for f in df.schema.fields if is_numeric(f.dataType)])
    require_columns(df, names, "describe")
    return [names[i : i + DESCRIBE_BATCH] for i in range(0, len(names), DESCRIBE_BATCH)]


def description_facts(df: DataFrame, names: Sequence[str], approximate: bool = False) -> Facts:
    """Moments and sketch of each column: the first pass of ``describe``."""
    fractions = list(_QUARTILES) if approximate else around(_QUARTILES)
    aggregates = {}
    for name in names:
        value = clean(col(name), type_of(df, name)).cast("double")
        aggregates |= {f"{key} {name}": f(value) for key, f in _MOMENTS.items()}
        aggregates[f"sketch {name}"] = sketch(value, fractions)

    def rows(get: Lookup) -> list[Column]:
        keys = [*_MOMENTS, "sketch"]
        return [F.struct(F.lit(n).alias("column"), *[get(f"{k} {n}").alias(k) for k in keys]) for n in names]

    return Facts(aggregates, rows, "column string, count bigint, mean double, std double, min double, max double, sketch array<double>")


def description_rows(df: DataFrame, first: Sequence[Row], approximate: bool = False) -> list[tuple]:
    """Rows of ``describe`` for the columns of a first pass."""
    names = [r["column"] for r in first]
    keys = [f"v{i}" for i in range(len(names))]
    if approximate:
        quartiles = {k: r["sketch"] or [None] * 3 for k, r in zip(keys, first)}
    else:
        values = df.select(*[clean(col(n), type_of(df, n)).cast("double").alias(k) for n, k in zip(names, keys)])
        start = {k: (r["count"], r["sketch"]) for k, r in zip(keys, first)}
        quartiles = exact_quantiles(values, keys, _QUARTILES, first=start)
    return [
        (r["column"], r["count"], r["mean"], r["std"], r["min"], *quartiles[k], r["max"]) for k, r in zip(keys, first)
    ]


def describe(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) of the numeric columns.

    Quartiles are exact with linear interpolation, from two scans for each DESCRIBE_BATCH
    columns. ``approximate`` takes them from a sketch in the first scan instead.
    """
    rows = []
    for names in described_columns(df, columns):
        first = tables(df, {"first": description_facts(df, names, approximate)})["first"]
        rows += description_rows(df, first, approximate)
    return df.sparkSession.createDataFrame(rows, DESCRIPTION)


def warning_facts(
    df: DataFrame,
    spatial: tuple[str, str] | None = None,
    numeric: Sequence[tuple[str, Sequence[float] | None]] = (),
    categorical: Sequence[str] = (),
) -> Facts:
    """See ``data_warnings``."""
    names = df.columns
    aggregates = missing_aggregates(df, names)
    if spatial is not None:
        counts = _spatial_counts(as_number(df, spatial[0]), as_number(df, spatial[1]))
        aggregates |= {f"{key} {spatial}": c for key, c in counts.items()}
    for name, limits in numeric:
        n_finite, n_inside = _diagnostic_counts(as_number(df, name), limits)
        aggregates |= {f"finite {name}": n_finite, f"inside {limits} {name}": n_inside}

    def rows(get: Lookup) -> list[Column]:
        n = get("rows")
        findings: list[Column] = []

        def add(hit: Column, code: str, name: str | None, message: Column | str) -> None:
            text = F.lit(message) if isinstance(message, str) else message
            row = F.struct(F.lit(code).alias("code"), F.lit(name).cast("string").alias("column"), text.alias("message"))
            findings.append(F.when(hit, row))

        # The sentences below are part of the report format.
        add(n == 0, "empty_catalog", None, "Catalog is empty.")
        for name in names:
            add((n > 0) & (get(f"missing {name}") == n), "all_null", name, f"Column {name!r} is entirely null.")
        if spatial is not None:
            ra, dec = spatial
            for key, name, tail in (
                ("nonfinite_ra", ra, " non-finite coordinate values."),
                ("nonfinite_dec", dec, " non-finite coordinate values."),
                ("ra_outside_range", ra, " values outside [0, 360)."),
                ("dec_outside_range", dec, " values outside [-90, 90]."),
            ):
                k = get(f"{key} {spatial}")
                add(k > 0, key, name, F.concat(F.lit(f"Column {name}: "), k.cast("string"), F.lit(tail)))
            none = get(f"valid_pairs {spatial}") == 0
            add(none, "no_valid_pairs", None, "Spatial plot has no finite RA/Dec pairs.")
        for name, limits in numeric:
            n_finite, n_inside = get(f"finite {name}"), get(f"inside {limits} {name}")
            text = f"Configured numeric column {name!r} has no finite values."
            add(n_finite == 0, "no_finite_values", name, text)
            if limits is not None:
                text = f"Column {name!r} has no values inside histogram range {list(limits)!r}."
                add((n_finite > 0) & (n_inside == 0), "none_in_range", name, text)
        for name in categorical:
            hit = (n == 0) | (get(f"missing {name}") == n) if name in names else F.lit(True)
            add(hit, "no_categories", name, f"Configured categorical column {name!r} has no non-null categories.")
        return findings

    return Facts(aggregates, rows, "code string, column string, message string")


def data_warnings(
    df: DataFrame,
    spatial: tuple[str, str] | None = None,
    numeric: Sequence[tuple[str, Sequence[float] | None]] = (),
    categorical: Sequence[str] = (),
) -> DataFrame:
    """(code, column, message) of every objective finding, all from one pass over the catalog."""
    return table(df, warning_facts(df, spatial, numeric, categorical))

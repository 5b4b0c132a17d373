"""The quality job: the aggregate tables behind every quality plot of a catalog."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame

from skyloom.functions.expr import require_columns
from skyloom.operators.facts import tables
from skyloom.operators.footprint import curve_segments, unusable_footprint_warning
from skyloom.operators.quality import (
    DESCRIPTION,
    described_columns,
    description_facts,
    description_rows,
    histogram1d,
    histogram2d,
    missing_facts,
    range_facts,
    row_count_facts,
    value_counts,
    warning_facts,
)


def qa(
    df: DataFrame, plots: Mapping[str, Any] | None = None, footprints: Mapping[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Small result tables by name.

    One pass finds all scalar facts at once: row count, missing values, what the warnings need,
    observed ranges of histograms and the first pass of the description. Then each histogram and
    each table of categories is one aggregation, run when it is read.

    ``plots`` may hold ``spatial`` {ra_column, dec_column}, ``redshift`` and
    ``redshift_error`` {column, bins, range}, ``quality`` {column} and
    ``categorical`` [{column}]. ``footprints`` maps labels to curve tables.
    """
    plots = plots or {}
    spatial, numeric, binned, categorical = None, [], [], []
    if plots.get("spatial"):
        spatial = (plots["spatial"].get("ra_column", "ra"), plots["spatial"].get("dec_column", "dec"))
        require_columns(df, spatial, "spatial plot")
    for key, default in (("redshift", "redshift"), ("redshift_error", "redshift error")):
        if plots.get(key):
            plot = plots[key]
            name = plot.get("column", default)
            require_columns(df, [name], f"{key} plot")
            numeric.append((name, plot.get("range")))
            binned.append((f"{key}_histogram", name, int(plot.get("bins", 50)), plot.get("range")))
    listed = ([plots["quality"]] if plots.get("quality") else []) + list(plots.get("categorical") or [])
    for plot in listed:
        name = plot.get("column", "quality")
        require_columns(df, [name], "category plot")
        categorical.append(name)

    batches = described_columns(df)
    shown = {
        "row_count": row_count_facts(),
        "missing": missing_facts(df),
        "warnings": warning_facts(df, spatial, numeric, categorical),
    }
    ranges = range_facts(df, [name for _, name, _, limits in binned if limits is None])
    rows = tables(df, {**shown, "ranges": ranges, "first": description_facts(df, batches[0] if batches else [])})
    described = description_rows(df, rows["first"])
    for names in batches[1:]:
        described += description_rows(df, tables(df, {"first": description_facts(df, names)})["first"])
    observed = {r["column"]: (r["min_value"], r["max_value"]) for r in rows["ranges"]}

    spark = df.sparkSession
    made = {name: spark.createDataFrame(rows[name], facts.schema) for name, facts in shown.items()}
    made["describe"] = spark.createDataFrame(described, DESCRIPTION)
    if spatial:
        made["sky_density"] = histogram2d(df, *spatial)
    for label, name, bins, limits in binned:
        made[label] = histogram1d(df, name, bins, observed[name] if limits is None else limits)
    for name in categorical:
        made[f"counts_{name}"] = value_counts(df, name, drop_missing=True)
    found = [made["warnings"]]
    for label, vertices in (footprints or {}).items():
        made[f"footprint_{label}"] = curve_segments(vertices)
        found.append(unusable_footprint_warning(vertices, label))
    made["warnings"] = reduce(DataFrame.unionByName, found)
    return made

"""The inspection job: every profile table of a catalog, and its JSON report."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from skyloom.functions.expr import col, is_numeric, type_of
from skyloom.operators.profile import (
    candidate_columns,
    categorical_uniques,
    footer_stats,
    patterns_with,
    report_columns,
    sample_columns,
    sample_random,
    semantic_warning_facts,
    stats_columns,
    stats_facts,
)
from skyloom.operators.facts import tables
from skyloom.operators.quality import row_count_facts
from skyloom.session import write_text


def inspect(
    df: DataFrame,
    survey: str = "catalog",
    source: str = "",
    column_selection: Sequence[str] | None = None,
    column_patterns: Mapping[str, Sequence[str]] | None = None,
    stats_mode: str = "candidates",
    unique_limit: int = 10,
    sample_max_columns: int = 100,
    sample_key: str | None = None,
    sample_seed: int = 42,
    extremes_only: bool = False,
    footers: str | None = None,
) -> dict[str, Any]:
    """Profile of a catalog as plain values.

    All scalar facts (counts, statistics, what the warnings need) come from one pass.

    ``sample_key`` draws the five sample rows at random by that key instead of
    from the front. ``extremes_only`` leaves out mean and deviation, which
    footers cannot answer, as for spatial catalogs; ``footers`` names the Parquet files of
    such a catalog, and statistics are read from their footers as far as these can tell.
    """
    patterns = patterns_with(column_patterns)
    columns = report_columns(df, column_selection)
    chosen = df.select(*[col(c) for c in columns])
    warnings: list[str] = []
    if column_selection is not None:
        warnings.append(
            f"Report was limited to {len(columns)} selected columns out of {len(df.columns)} available columns."
        )
    candidates = candidate_columns(columns, patterns)
    flat = [c for found in candidates.values() for c in found]
    shown = sample_columns(columns, flat, sample_max_columns)
    if len(shown) < len(columns):
        warnings.append(f"Sample was limited to {len(shown)} of {len(columns)} columns.")
    numeric, categorical = stats_columns(chosen, columns, stats_mode, patterns)
    if stats_mode == "none":
        warnings.append("Statistics were skipped because stats_mode='none'.")
    elif stats_mode == "candidates" and not numeric and not categorical:
        warnings.append("No candidate columns were eligible for statistics.")
    vectors = [c for c in columns if type_of(df, c).typeName() == "array" and (stats_mode == "all" or c in flat)]
    if vectors and stats_mode != "none":
        warnings.append("Vector columns were skipped in statistics: " + ", ".join(vectors) + ".")

    facts = {"rows": row_count_facts(), "warnings": semantic_warning_facts(chosen, patterns)}
    if footers is None:
        facts["stats"] = stats_facts(chosen, numeric, moments=not extremes_only)
    found = tables(chosen, facts)
    rows_of_stats = found["stats"] if footers is None else footer_stats(df.sparkSession, footers, numeric).collect()
    stats = {
        r["column"]: {k: r[k] for k in ("count", "null_count", "mean", "std", "min", "max")} for r in rows_of_stats
    }
    uniques: dict[str, list[str]] = {c: [] for c in categorical}
    for r in categorical_uniques(chosen, categorical, unique_limit).orderBy("column", "rank").collect():
        uniques[r["column"]].append(r["value"])
    warnings += [r["message"] for r in found["warnings"]]
    rows = sample_random(chosen, sample_key, 5, sample_seed) if sample_key else chosen.limit(5)
    return {
        "survey": survey,
        "input_file": source,
        "n_rows": found["rows"][0]["n_rows"],
        "n_columns": len(df.columns),
        "n_columns_selected": len(columns),
        "columns": columns,
        "dtypes": {c: type_of(df, c).simpleString() for c in columns},
        "numeric_columns": [c for c in columns if is_numeric(type_of(df, c))],
        "candidates": candidates,
        "numeric_stats": stats,
        "categorical_uniques": uniques,
        "sample": [r.asDict(recursive=True) for r in rows.select(*[col(c) for c in shown]).collect()] if shown else [],
        "warnings": warnings,
    }


def _plain(value: Any) -> str:
    """Binary cells as the text they hold, everything else as it prints."""
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value).decode("utf-8", "replace")
    return str(value)


def write_report(spark: SparkSession, report: Mapping[str, Any], path: str) -> None:
    """Save a profile as one JSON document."""
    write_text(spark, path, json.dumps(report, indent=2, default=_plain))

"""Catalog profiling: semantic candidates, numeric statistics, uniques, samples, warnings."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from skyloom.functions.expr import (
    CatalogError,
    clean,
    col,
    is_categorical,
    is_numeric,
    ordered_unique,
    require_columns,
    type_of,
)
from skyloom.operators.facts import Facts, Lookup, table
from skyloom.operators.quality import missing_aggregates

# Name patterns of each semantic category (searched anywhere, ignoring case).
PATTERNS: dict[str, list[str]] = {
    "ra": [
        r"^ra$",
        r"(^|_)ra_deg($|_)",
        r"(^|_)target_ra($|_)",
        r"(^|_)obsra($|_)",
        r"(^|_)ra_j2000($|_)",
        r"^alpha",
        r"(^|_)right_ascension($|_)",
    ],
    "dec": [
        r"^dec$",
        r"dec_deg",
        r"target_dec",
        r"obsdec",
        r"dec_j2000",
        r"^delta",
        r"(^|_)declination($|_)",
    ],
    "redshift": [
        r"^z$",
        r"redshift",
        r"zspec",
        r"z_spec",
        r"zphot",
        r"z_phot",
        r"best_z",
        r"z_ml",
        r"z_helio",
    ],
    "quality": [
        r"quality",
        r"qual",
        r"qop",
        r"(^|_)flag($|_)",
        r"zflag",
        r"zwarn",
        r"zwarning",
        r"z_flag",
        r"vi_quality",
        r"confidence",
    ],
    "redshift_error": [
        r"(^|_)z_err($|_)",
        r"^zerr$",
        r"(^|_)err_z($|_)",
        r"(^|_)z_error($|_)",
        r"(^|_)sigma_z($|_)",
    ],
    "id": [
        r"^id$",
        r"(^|_)objectid($|_)",
        r"(^|_)object_id($|_)",
        r"(^|_)targetid($|_)",
        r"(^|_)specid($|_)",
        r"(^|_)catalogid($|_)",
        r"^tileid$",
    ],
    "object_type": [
        r"(^|_)class($|_)",
        r"(^|_)subclass($|_)",
        r"(^|_)objtype($|_)",
        r"(^|_)spectype($|_)",
        r"(^|_)subtype($|_)",
        r"(^|_)eta_type($|_)",
        r"^type$",
    ],
}

STATS_BATCH = 200
NULL_WARNING_FRACTION = 0.5


def patterns_with(configured: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """Default patterns; a configured category replaces that category's list."""
    return {**PATTERNS, **{k: list(v) for k, v in (configured or {}).items()}}


def _any_of(patterns: Sequence[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def candidate_columns(
    columns: Sequence[str], patterns: Mapping[str, Sequence[str]] | None = None
) -> dict[str, list[str]]:
    """Column names per semantic category, for planning over one catalog's schema."""
    table = PATTERNS if patterns is None else patterns
    return {k: [c for c in columns if p and re.search(_any_of(p), c)] for k, p in table.items()}


def classify_names(
    names: DataFrame, column: str = "name", patterns: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """One row per (name, matching category), for the names of any number of catalogs at once."""
    table = PATTERNS if patterns is None else patterns
    tests = [F.when(col(column).rlike(_any_of(p)), F.lit(k)) for k, p in table.items() if p]
    return names.select("*", F.explode(F.array_compact(F.array(*tests))).alias("category"))


def stats_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    mode: str = "candidates",
    patterns: Mapping[str, Sequence[str]] | None = None,
) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns to profile: semantic candidates, all, or none."""
    if mode not in ("candidates", "all", "none"):
        raise CatalogError("stats_mode must be one of: candidates, all, none.")
    names = list(columns or df.columns)
    if mode == "none":
        return [], []
    if mode == "candidates":
        chosen = {c for found in candidate_columns(names, patterns).values() for c in found}
        names = [n for n in names if n in chosen]
    return (
        [n for n in names if is_numeric(type_of(df, n))],
        [n for n in names if is_categorical(type_of(df, n))],
    )


def report_columns(df: DataFrame, selection: Sequence[str] | None) -> list[str]:
    """Columns of a report; a selected column must exist."""
    if selection is None:
        return list(df.columns)
    chosen = ordered_unique(n.strip() for n in selection if n.strip())
    absent = [n for n in chosen if n not in df.columns]
    if absent:
        raise CatalogError(f"The catalog has none of the selected columns {', '.join(absent)}.")
    return chosen


STATS = "column string, count bigint, null_count bigint, mean double, std double, min double, max double"


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None, moments: bool = True) -> DataFrame:
    """(column, count, null_count, mean, std, min, max); NULL where undefined.

    One aggregation serves up to STATS_BATCH columns. Without ``moments`` only
    counts and extremes are computed; ``footer_stats`` finds those of files.
    """
    names = list(columns if columns is not None else [f.name for f in df.schema.fields if is_numeric(f.dataType)])
    require_columns(df, names, "numeric_stats")
    batches = [names[i : i + STATS_BATCH] for i in range(0, len(names), STATS_BATCH)]
    parts = [table(df, stats_facts(df, batch, moments)) for batch in batches]
    if not parts:
        return df.sparkSession.createDataFrame([], STATS)
    return reduce(DataFrame.unionByName, parts)


def stats_facts(df: DataFrame, names: Sequence[str], moments: bool = True) -> Facts:
    """See ``numeric_stats``."""
    aggregates = {"rows": F.count(F.lit(1))}
    kinds = {"count": F.count, "min": F.min, "max": F.max} | ({"mean": F.avg, "std": F.stddev_samp} if moments else {})
    for name in names:
        v = clean(col(name), type_of(df, name)).cast("double")
        aggregates |= {f"{kind} {name}": f(v) for kind, f in kinds.items()}

    def rows(get: Lookup) -> list[Column]:
        def one(kind: str, name: str) -> Column:
            return get(f"{kind} {name}") if kind in kinds else F.lit(None).cast("double")

        return [
            F.struct(
                F.lit(name).alias("column"),
                get(f"count {name}").alias("count"),
                (get("rows") - get(f"count {name}")).alias("null_count"),
                *[one(kind, name).alias(kind) for kind in ("mean", "std", "min", "max")],
            )
            for name in names
        ]

    return Facts(aggregates, rows, STATS)


def footer_frame(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """One row (n, n0, lo0, hi0, n1, ...) of counts and extremes of whole-number columns, read from Parquet footers.

    The settings that let Spark answer from footers are those of a session of its own, so the
    caller's queries are planned as before.
    """
    side = spark.newSession()
    side.conf.set("spark.sql.caseSensitive", "true")
    side.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    listed = side.conf.get("spark.sql.sources.useV1SourceList")
    side.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in listed.split(",") if s.strip() != "parquet"))
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(columns):
        c = col(name)
        aggregates += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    return side.read.parquet(path).agg(*aggregates)


def footer_stats(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``numeric_stats`` without moments of a Parquet file or folder, from its footers where they can tell.

    Footers know the nulls and extremes of whole numbers. They do not know which floats are
    NaN, and decimals have no pushed extremes: those columns are scanned, and only
    those. Files that lack statistics (a row group of nulls has no extremes) are scanned too.
    """
    df = spark.read.parquet(path)
    names = list(columns if columns is not None else [f.name for f in df.schema.fields if is_numeric(f.dataType)])
    require_columns(df, names, "footer_stats")
    whole = [n for n in names if isinstance(type_of(df, n), T.IntegralType)]
    found: list[tuple] = []
    if whole:
        try:
            row = footer_frame(spark, path, whole).collect()[0]
        except (PySparkException, Py4JJavaError) as error:
            if "spark.sql.parquet.aggregatePushdown" not in str(error):
                raise  # anything but the advice to do without footers
            whole = []
        else:
            for i, name in enumerate(whole):
                n, low, high = (row[f"{k}{i}"] for k in ("n", "lo", "hi"))
                ends = (None if v is None else float(v) for v in (low, high))
                found.append((name, n, row["n"] - n, None, None, *ends))
    known = spark.createDataFrame(found, STATS)
    rest = [n for n in names if n not in whole]
    return known.unionByName(numeric_stats(df, rest, moments=False)) if rest else known


def categorical_uniques(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 10) -> DataFrame:
    """(column, value, rank): the first ``limit`` distinct non-empty values of each column, by value.

    A first scan takes the least value of each of some hash buckets. These are
    distinct values, so the ``limit``-th of them is no less than the last value
    wanted, and only values up to it are made distinct and ranked: a column of
    a trillion identifiers does not shuffle them.
    """
    names = list(columns if columns is not None else [f.name for f in df.schema.fields if is_categorical(f.dataType)])
    require_columns(df, names, "categorical_uniques")
    if not names or limit <= 0:
        return df.sparkSession.createDataFrame([], "column string, value string, rank int")

    def text(name: str) -> Column:
        if isinstance(type_of(df, name), T.BooleanType):
            return F.initcap(col(name).cast("string"))
        return F.trim(col(name).cast("string"))

    pairs = [F.struct(F.lit(n).alias("column"), text(n).alias("value")) for n in names]
    values = df.select(F.inline(F.array(*pairs))).where(F.col("value") != "")
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    bucket = F.pmod(F.xxhash64("value"), F.lit(max(64, 8 * limit)))
    least = values.groupBy("column", bucket.alias("bucket")).agg(F.min("value").alias("value"))
    bounds = least.withColumn("rank", rank).where(F.col("rank") == limit)
    bounds = bounds.select(F.col("column").alias("of"), F.col("value").alias("bound"))
    # At most one row per column; a column with fewer full buckets has no bound and few values.
    near = values.join(F.broadcast(bounds), F.col("column") == F.col("of"), "left")
    near = near.where(F.col("bound").isNull() | (F.col("value") <= F.col("bound")))
    return near.select("column", "value").distinct().withColumn("rank", rank).where(F.col("rank") <= limit)


def sample_columns(columns: Sequence[str], candidates: Sequence[str], max_columns: int = 100) -> list[str]:
    """Semantic candidates first, then the other columns, at most ``max_columns``."""
    return ordered_unique([*candidates, *columns])[: max(max_columns, 0)]


def sample_head(df: DataFrame, key: str | None = None, rows: int = 5, max_columns: int = 100) -> DataFrame:
    """First rows, in key order if a key is given so that the sample is repeatable."""
    flat = [c for found in candidate_columns(df.columns).values() for c in found]
    chosen = sample_columns(df.columns, flat, max_columns)
    ordered = df.orderBy(col(key)) if key else df
    return ordered.limit(rows).select(*[col(n) for n in chosen])


def sample_random(df: DataFrame, key: str, rows: int = 5, seed: int = 42) -> DataFrame:
    """Random rows that depend on key and seed only, not on how the catalog is partitioned."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), col(key).cast("string")).cast("binary"))
    return df.orderBy(draw, col(key)).limit(rows)


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def semantic_warning_facts(df: DataFrame, patterns: Mapping[str, Sequence[str]] | None = None) -> Facts:
    """See ``semantic_warnings``."""
    # The sentences below are part of the report format.
    found = candidate_columns(df.columns, patterns)
    numeric = {f.name for f in df.schema.fields if is_numeric(f.dataType)}
    ra, dec, z = (found.get(k, []) for k in ("ra", "dec", "redshift"))
    fixed: list[tuple[str, str, str]] = []
    for code, label, names in (("no_ra", "RA", ra), ("no_dec", "DEC", dec), ("no_redshift", "redshift", z)):
        if not names:
            fixed.append((code, "", f"No {label} candidate columns were found."))
    if len(z) > 1:
        listed = ", ".join(z)
        fixed.append(("several_redshifts", listed, f"Multiple redshift candidate columns were found: {listed}."))
    for code, label, names in (("ra_not_numeric", "RA", ra), ("dec_not_numeric", "DEC", dec)):
        text = ", ".join(n for n in names if n not in numeric)
        if text:
            fixed.append((code, text, f"{label} candidate columns are not numeric: {text}."))
    measured = [n for n in z if n in numeric]

    def rows(get: Lookup) -> list[Column]:
        made = [
            F.struct(F.lit(c).alias("code"), F.lit(n).alias("columns"), F.lit(m).alias("message")) for c, n, m in fixed
        ]
        parts, names_hit = [], []
        for name in measured:
            empty = get(f"missing {name}")
            share = empty / F.nullif(get("rows"), F.lit(0))
            hit = (share >= NULL_WARNING_FRACTION) & (empty > 0)
            text = F.concat(F.lit(f"{name} ("), F.format_string("%.1f", share * 100.0), F.lit("% null)"))
            parts.append(F.when(hit, text))
            names_hit.append(F.when(hit, F.lit(name)))
        if parts:
            listed = F.concat_ws(", ", *parts)
            message = F.concat(F.lit("Redshift candidate columns have many null values: "), listed, F.lit("."))
            nulls = F.struct(
                F.lit("redshift_nulls").alias("code"),
                F.concat_ws(", ", *names_hit).alias("columns"),
                message.alias("message"),
            )
            made.append(F.when(listed != "", nulls))
        return made

    return Facts(missing_aggregates(df, measured), rows, "code string, columns string, message string")


def semantic_warnings(df: DataFrame, patterns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(code, columns, message) of what the column names and the redshift nulls give reason to warn of."""
    return table(df, semantic_warning_facts(df, patterns))

"""Delimited and whitespace text, typed by what the whole column holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyloom.functions.expr import CatalogError, as_number, col, number_from_text, spark_type
from skyloom.operators.footprint import footprint_format

# Text that stands for a missing value in catalog files.
MISSING_TEXT = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
# Spellings of truth values.
_TRUE, _FALSE = ["True", "TRUE", "true"], ["False", "FALSE", "false"]


def _parsers(text: Column) -> dict[str, Column]:
    """Target types in the order they are tried, each NULL where the text does not fit."""
    integer = F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text)).try_cast("bigint")
    truth = F.when(text.isin(*_TRUE), F.lit(True)).when(text.isin(*_FALSE), F.lit(False))
    return {"bigint": integer, "double": number_from_text(text), "boolean": truth}


def type_columns(raw: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """Give every text column the first type all its present values fit.

    One aggregation over the file decides for all columns. Columns named in
    ``types`` are cast as asked; if that covers every column nothing is scanned.
    """
    types = dict(types or {})
    blank = {c: F.when(~col(c).isin(*MISSING_TEXT), col(c)) for c in raw.columns}
    open_columns = [c for c in raw.columns if c not in types]
    chosen = {c: spark_type(t) for c, t in types.items()}
    if open_columns:
        aggs = []
        for i, c in enumerate(open_columns):
            aggs.append(F.count(blank[c]).alias(f"n{i}"))
            aggs += [F.count(p).alias(f"{k}{i}") for k, p in _parsers(blank[c]).items()]
        row = raw.agg(*aggs).first()
        for i, c in enumerate(open_columns):
            fits = [k for k in _parsers(col(c)) if row[f"{k}{i}"] == row[f"n{i}"]]
            # A column without a single value is a float column of nothing.
            chosen[c] = ("double" if row[f"n{i}"] == 0 else fits[0]) if fits else "string"
    typed = []
    for c in raw.columns:
        value = _parsers(blank[c]).get(chosen[c], blank[c].cast(chosen[c]))
        typed.append(value.alias(c))
    return raw.select(*typed)


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    types: Mapping[str, str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Comma-separated text with a header line, plain or gzip; all files share the header."""
    raw = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    _refuse_renamed(raw, paths)
    return type_columns(raw, types)


def _refuse_renamed(raw: DataFrame, paths: str | Sequence[str]) -> None:
    """A session that ignores case gives names that differ by case only their positions as a suffix; say so at once."""
    stems = [n.removesuffix(str(i)).lower() for i, n in enumerate(raw.columns)]
    renamed = [n for i, n in enumerate(raw.columns) if n.endswith(str(i)) and stems.count(stems[i]) > 1]
    if len(renamed) > 1 and raw.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
        header = raw.sparkSession.read.option("escape", '"').csv(paths if isinstance(paths, str) else paths[0]).first()
        if header is None or list(header) == raw.columns:
            return
        names = ", ".join(n.removesuffix(str(raw.columns.index(n))) for n in renamed)
        raise CatalogError(f"Columns differ by case only ({names}); set spark.sql.caseSensitive to true to read them.")


def read_whitespace(
    spark: SparkSession,
    paths: str | Sequence[str],
    column_names: Sequence[str] | None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Text without a header, fields separated by blanks; ``#`` starts a comment, ``"`` holds a field with blanks together."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    body = F.regexp_replace("value", r'^((?:[^"#]|"[^"]*")*)#.*$', "$1")
    parts = F.regexp_extract_all(body, F.lit(r'"[^"]*"|[^\s"]+'), 0)
    bare = F.transform(parts, lambda p: F.translate(p, '"', ""))
    fields = lines.select(bare.alias("f")).where(F.size("f") > 0)
    width = fields.agg(F.max(F.size("f")).alias("w")).first()["w"]
    if not column_names:
        raise CatalogError(f"The file has no header; column_names must name its {width} columns.")
    if width is not None and width != len(column_names):
        raise CatalogError(f"The file has {width} columns, column_names {len(column_names)}.")
    raw = fields.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(column_names)])
    return type_columns(raw, types)


def read_footprint(spark: SparkSession, path: str, expected: str | None = None) -> DataFrame:
    """Footprint curve file in either format; its coordinates become doubles, bad ones NULL."""
    raw = spark.read.option("header", True).csv(path)
    kind = footprint_format(raw.columns, expected)
    numeric = ["vertex_id", "ra_deg", "dec_deg"] if kind == "region_vertices" else ["ra_center", "dec_limit"]
    return reduce(lambda df, c: df.withColumn(c, as_number(df, c)), numeric, raw)

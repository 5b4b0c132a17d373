"""One entry to every supported file format."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from skyloom.functions.expr import CatalogError, col
from skyloom.session import is_dir, list_names
from skyloom.sources import fits
from skyloom.sources.collection import read_spatial
from skyloom.sources.text import read_csv, read_whitespace

# Reader code travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(fits)

# File suffixes of each format.
_SUFFIXES = {
    "csv": (".csv", ".txt"),
    "whitespace": (".dat", ".idz"),
    "parquet": (".parquet", ".pq"),
    "fits": (".fits", ".fit", ".fts"),
}


def read_fits(
    spark: SparkSession,
    paths: str | Sequence[str],
    hdu: int = 1,
    columns: Sequence[str] | None = None,
    chunk_rows: int = fits.CHUNK_ROWS,
    target_bytes: int = fits.PARTITION_BYTES,
) -> DataFrame:
    """Binary table HDU, split into row ranges; name ``columns`` to decode only those."""
    files = [f for p in ([paths] if isinstance(paths, str) else paths) for f in fits.expand(p)]
    if not files:
        raise CatalogError("No FITS files to read.")
    spark.dataSource.register(fits.FitsDataSource)
    reader = spark.read.format("fits").option("path", "\n".join(files)).option("hdu", hdu)
    reader = reader.option("chunk_rows", chunk_rows).option("target_bytes", target_bytes)
    if columns:
        reader = reader.option("columns", "\n".join(columns))
    return reader.load()


def read_parquet(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet files or folders; row groups split over tasks by Spark's scan.

    The columns are those of all files (one job reads the footers), NULL where a file lacks one.
    """
    df = spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*[col(c) for c in columns]) if columns else df


def format_of(spark: SparkSession, path: str, column_names: Sequence[str] | None = None) -> str:
    """Format by suffix (compression suffixes aside); a folder must be a Parquet dataset."""
    if is_dir(spark, path):
        names = list_names(spark, path)
        if "hats.properties" in names or "collection.properties" in names:
            return "spatial"
        if "_metadata" in names or any(n.endswith((".parquet", ".pq")) for n in names):
            return "parquet"
        raise CatalogError(f"{path} is a folder without Parquet files.")
    name = re.sub(r"\.(gz|bz2)$", "", path.lower())
    if name.endswith(".txt") and column_names:
        return "whitespace"
    for kind, suffixes in _SUFFIXES.items():
        if name.endswith(suffixes):
            return kind
    raise CatalogError(f"Unsupported input format: {path}.")


def schema_frame(
    spark: SparkSession, path: str, kind: str, column_names: Sequence[str] | None = None, hdu: int = 1
) -> DataFrame:
    """A frame with the columns of a file, known from its header or footer alone (text is not typed yet)."""
    if kind == "whitespace":
        if not column_names:
            raise CatalogError("Text without a header needs column_names.")
        return spark.createDataFrame([], ", ".join(f"`{n.replace('`', '``')}` string" for n in column_names))
    if kind == "csv":
        return spark.read.option("header", True).option("escape", '"').csv(path)
    return read_fits(spark, path, hdu) if kind == "fits" else spark.read.parquet(path)


def read_files(
    spark: SparkSession,
    paths: Sequence[str],
    kind: str,
    column_names: Sequence[str] | None = None,
    hdu: int = 1,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read files of one format and one schema in one scan."""
    if kind == "parquet":
        return read_parquet(spark, paths, columns)
    if kind == "fits":
        return read_fits(spark, paths, hdu, columns)
    df = read_csv(spark, paths) if kind == "csv" else read_whitespace(spark, paths, column_names)
    return df.select(*[col(c) for c in columns]) if columns else df


def read_catalog(
    spark: SparkSession,
    path: str,
    column_names: Sequence[str] | None = None,
    hdu: int = 1,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read one catalog file of any supported format."""
    kind = format_of(spark, path, column_names)
    if kind == "spatial":
        return read_spatial(spark, path, columns)
    return read_files(spark, [path], kind, column_names, hdu, columns)

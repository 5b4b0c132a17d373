"""Parquet output and run manifests. Nothing that exists is touched before the new data is complete."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.functions.expr import CatalogError
from skyloom.session import path_exists, replacing, within, write_text

def check_output(spark: SparkSession, path: str, overwrite: bool, sources: Sequence[str] | None = None) -> None:
    """Refuse an output that exists (unless it may be replaced) or whose replacement would delete a source."""
    for source in sources or ():
        if within(spark, source, path):
            raise CatalogError(f"The output {path} holds the input {source}; write to another place.")
    if not overwrite and path_exists(spark, path):
        raise CatalogError(f"{path} already exists; overwrite=True replaces it.")


def output_layout(mode: str) -> str:
    """``partitioned`` keeps the parallelism of the job, ``single`` writes one file; ``auto`` is the former at every size."""
    layouts = {"auto": "partitioned", "partitioned": "partitioned", "single": "single"}
    if mode not in layouts:
        raise CatalogError(f"output_mode {mode!r} is unknown; known are {', '.join(layouts)}.")
    return layouts[mode]


@contextmanager
def _partitions_of(spark: SparkSession, size: int) -> Iterator[None]:
    """While the block runs, rebalanced writes aim at partitions of ``size`` bytes, even if few tasks are left."""
    wanted = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(size),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(size),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def write_files(df: DataFrame, path: str, mode: str = "partitioned", target_partition_bytes: int | None = None) -> None:
    """Write a frame as Parquet files to a path that nothing is at.

    The partitioned form keeps the scan's partitions and moves no data, unless
    ``target_partition_bytes`` asks for partitions of about that size: then one
    shuffle of the rows that are written splits large and merges small ones. In a
    single file only the write is one task.
    """
    if output_layout(mode) == "single":
        df.repartition(1).write.parquet(path)
    elif target_partition_bytes is None:
        df.write.parquet(path)
    elif target_partition_bytes <= 0:
        raise CatalogError("target_partition_bytes must be positive.")
    else:
        with _partitions_of(df.sparkSession, target_partition_bytes):
            df.hint("rebalance").write.parquet(path)


def write_parquet(
    df: DataFrame,
    path: str,
    mode: str = "partitioned",
    overwrite: bool = False,
    target_partition_bytes: int | None = None,
    sources: Sequence[str] | None = None,
    finish: Callable[[str], None] | None = None,
) -> None:
    """Write a catalog; ``finish`` gets the folder before it takes its place, and may raise to call it off."""
    spark = df.sparkSession
    check_output(spark, path, overwrite, sources)
    with replacing(spark, path) as staged:
        write_files(df, staged, mode, target_partition_bytes)
        if finish is not None:
            finish(staged)


def write_manifest(spark: SparkSession, path: str, facts: dict[str, Any]) -> None:
    """Run manifest next to the data; readers skip names that start with an underscore."""
    write_text(spark, f"{path.rstrip('/')}/_curation_manifest.json", json.dumps(facts, indent=2, default=str))


def file_count(spark: SparkSession, path: str) -> int:
    """Number of data files of a written dataset."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").format("binaryFile")
    return files.load(path).select(F.col("path")).count()

"""The preparation job: raw files of one format to one Parquet dataset or spatial collection."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from skyloom.functions.expr import CatalogError
from skyloom.operators.union import check_same_columns, union_outer, union_strict
from skyloom.sinks.collection import write_collection
from skyloom.sinks.parquet import check_output, file_count, output_layout, write_manifest, write_parquet
from skyloom.sources.headers import file_columns, names_of
from skyloom.sources.readers import format_of, read_files, schema_frame


def read_sources(
    spark: SparkSession,
    paths: Sequence[str],
    schema_policy: str = "strict",
    column_names: Sequence[str] | None = None,
    hdu: int = 1,
) -> DataFrame:
    """All files as one catalog; ``strict`` demands equal columns, ``union`` fills the gaps with NULL.

    Files that share a schema are read by one scan (and typed by one pass), so
    the plan grows with the number of different schemas, not of files.
    """
    if schema_policy not in ("strict", "union"):
        raise CatalogError(f"schema_policy {schema_policy!r} is neither strict nor union.")
    kinds = {p: format_of(spark, p, column_names) for p in paths}
    if "spatial" in kinds.values():
        raise CatalogError("A spatial catalog is prepared already; read it as it is.")
    if len(set(kinds.values())) != 1:
        raise CatalogError("Files of different formats cannot be read as one catalog.")
    kind = kinds[paths[0]]
    groups = _by_columns(spark, paths, kind, schema_policy == "strict", column_names, hdu)
    frames = [read_files(spark, group, kind, column_names, hdu) for group in groups]
    return union_strict(frames) if schema_policy == "strict" else union_outer(frames)


def _by_columns(spark: SparkSession, paths: Sequence[str], kind: str, strict: bool, column_names: Sequence[str] | None, hdu: int) -> list[list[str]]:
    """Paths that can be read together, from the headers of all files; ``strict`` refuses files whose column names differ."""
    if kind == "whitespace":  # no headers; the names are the caller's
        return [list(paths)]
    groups: dict[str, list[str]] = {}
    found = file_columns(spark, paths, kind, hdu)
    if found is None:  # a store that only Spark opens: its readers tell the columns, file by file
        headers = {p: schema_frame(spark, p, kind, column_names, hdu) for p in paths}
        for path, frame in headers.items():
            groups.setdefault(frame.schema.json(), []).append(path)
        if strict:
            check_same_columns(headers)
        return list(groups.values())
    examples: dict[str, str] = {}
    for path, columns in found:
        groups.setdefault("\n".join(columns), []).append(path)
        for one in columns:
            examples.setdefault(", ".join(names_of(one)), path)
    if strict and len(examples) > 1:
        lines = [f"{path}: {names}" for names, path in examples.items()]
        raise CatalogError("\n".join(["All files must have the same schema, in the same order. Different ones, each with one of its paths:", *lines]))
    return list(groups.values())


def prepare(
    spark: SparkSession,
    paths: str | Sequence[str],
    output: str,
    output_format: str = "parquet",
    output_mode: str = "partitioned",
    schema_policy: str = "strict",
    column_names: Sequence[str] | None = None,
    hdu: int = 1,
    overwrite: bool = False,
    target_partition_bytes: int | None = None,
    ra: str | None = None,
    dec: str | None = None,
    **spatial: Any,
) -> str:
    """Write the files as one dataset and return its path (a Parquet folder needs no preparation)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if output_format not in ("parquet", "hats"):
        raise CatalogError(f"output_format {output_format!r} is neither parquet nor hats.")
    kind = format_of(spark, paths[0], column_names)
    if len(paths) == 1 and kind == "parquet" and output_format == "parquet" and not paths[0].endswith((".parquet", ".pq")):
        return paths[0]
    check_output(spark, output, overwrite, paths)
    df = read_sources(spark, paths, schema_policy, column_names, hdu)
    facts: dict[str, Any] = {
        "source_paths": paths,
        "source_format": kind,
        "partition_format": output_format,
        "requested_output_mode": output_mode,
        "columns": df.columns,
    }
    if output_format == "hats":
        if not ra or not dec:
            raise CatalogError("A spatial output is placed by ra and dec; name both columns.")
        facts["output_mode"] = "spatial"
        write_collection(df, output, ra, dec, overwrite=overwrite, facts=facts, **spatial)
        return output

    def finish(staged: str) -> None:
        done = {"output_mode": output_layout(output_mode), "n_partitions": file_count(spark, staged)}
        write_manifest(spark, staged, facts | done)

    write_parquet(df, output, output_mode, overwrite, target_partition_bytes, paths, finish)
    return output

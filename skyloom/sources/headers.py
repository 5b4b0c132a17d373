"""Columns of any number of files, from their headers or footers: one job over the list of files, no data read."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession

from skyloom.session import is_dir, list_files
from skyloom.sources.fits import read_table_header

#: Files that one task opens.
FILES_A_TASK = 200


def _first_line(stream: pa.NativeFile) -> str:
    """First line that is not blank; '' of an empty file."""
    held = b""
    while block := stream.read(1 << 16):
        held += block
        line = re.match(rb"\s*?([^\r\n]*[^\s][^\r\n]*)[\r\n]", held)
        if line:
            return line[1].decode("utf-8", "replace")
    return held.strip(b"\r\n").decode("utf-8", "replace")


def columns_of(path: str, kind: str, hdu: int) -> list[list[str]] | None:
    """(name, type) of a file's columns, CSV without types; None if the path is in a store that only Spark reads."""
    from pyarrow import fs, parquet

    if kind == "fits":
        return [[f.name, f.spark] for f in read_table_header(path, hdu).fields]
    try:
        store, inside = fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    if kind == "parquet":
        schema = parquet.read_schema(inside, filesystem=store)
        return [[f.name, str(f.type)] for f in schema]
    with store.open_input_stream(inside, compression="detect") as stream:
        return [[name, ""] for name in next(csv.reader([_first_line(stream)]), [])]


def file_columns(spark: SparkSession, paths: Sequence[str], kind: str, hdu: int = 1) -> list[tuple[str, list[str]]] | None:
    """For each path the different column lists of its files (as JSON, in the order of file names), by one job.

    A folder of Parquet files stands for all files below it. None if some path is in a store that only Spark's own readers open.
    """
    files = [(i, f) for i, p in enumerate(paths) for f in (list_files(spark, p, (".parquet", ".pq")) if kind == "parquet" and is_dir(spark, p) else [p])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [columns_of(p, kind, hdu) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("nth"), pa.array([None if f is None else json.dumps(f) for f in found], pa.string())], names=["nth", "found"])

    listed = spark.createDataFrame([(n, f) for n, (_, f) in enumerate(files)], "nth long, path string")
    tasks = max(1, min(len(files), max(spark.sparkContext.defaultParallelism, len(files) // FILES_A_TASK)))
    rows = sorted(listed.repartition(tasks).mapInArrow(read, "nth long, found string").collect())
    if any(r.found is None for r in rows):
        return None
    out: list[tuple[str, list[str]]] = [(p, []) for p in paths]
    for (i, _), row in zip(files, rows, strict=True):
        if row.found not in out[i][1]:
            out[i][1].append(row.found)
    return out


def names_of(found: str) -> list[str]:
    return [name for name, _ in json.loads(found)]


# Tasks get these functions with the job.
cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])

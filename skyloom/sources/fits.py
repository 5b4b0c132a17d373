"""FITS binary tables as a Spark data source.

The driver reads the header blocks only; every task seeks to its own row range
and turns the big-endian records into Arrow columns, array by array.
"""

from __future__ import annotations

import gzip
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 2880
# Default rows and bytes of one partition.
CHUNK_ROWS = 200_000
PARTITION_BYTES = 100 * 1024 * 1024
BATCH_ROWS = 20_000

# TFORM code -> (bytes, numpy type, Spark type).
_CODES = {
    "L": (1, "S1", "boolean"),
    "X": (1, "u1", "smallint"),
    "B": (1, "u1", "smallint"),
    "I": (2, ">i2", "smallint"),
    "J": (4, ">i4", "int"),
    "K": (8, ">i8", "bigint"),
    "A": (1, "S", "string"),
    "E": (4, ">f4", "float"),
    "D": (8, ">f8", "double"),
    "C": (8, ">f4", "array<float>"),
    "M": (16, ">f8", "array<double>"),
}
_ARROW = {
    "boolean": pa.bool_(),
    "smallint": pa.int16(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "float": pa.float32(),
    "double": pa.float64(),
    "string": pa.string(),
}
# TZERO that marks an unsigned (or, for bytes, a signed) integer column.
_SHIFTED = {("I", 32768): "int", ("J", 2147483648): "bigint", ("B", -128): "smallint"}


def rows_per_partition(chunk_rows: int, row_bytes: int, target_bytes: int) -> int:
    """Rows of one partition: the chunk size, but no more than the target bytes hold."""
    if row_bytes <= 0 or target_bytes <= 0:
        return chunk_rows
    return max(1, min(chunk_rows, target_bytes // row_bytes))


def open_file(path: str):
    """Binary file handle; a URI goes through the matching Arrow file system."""
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        handle = system.open_input_file(inner)
    else:
        handle = open(path, "rb")
    return gzip.GzipFile(fileobj=handle) if path.endswith(".gz") else handle


@dataclass(frozen=True)
class Field:
    name: str
    offset: int
    code: str
    repeat: int
    scale: float
    zero: float
    heap: str = ""  # "P" or "Q" where the row only points at values in the heap

    @property
    def shifted(self) -> str | None:
        return _SHIFTED.get((self.code, int(self.zero))) if self.scale == 1 else None

    @property
    def element(self) -> str:
        base = _CODES[self.code][2]
        if self.code in "BIJK" and (self.scale != 1 or self.zero != 0):
            return self.shifted or "double"
        return base

    @property
    def spark(self) -> str:
        if self.heap:
            return "string" if self.code == "A" else f"array<{self.element}>"
        if self.code == "A" or self.repeat == 1:
            return self.element
        return f"array<{self.element}>"


@dataclass(frozen=True)
class Table:
    fields: tuple[Field, ...]
    start: int
    row_bytes: int
    rows: int
    heap: int  # where the values of variable-length columns start


def _read_header(handle) -> dict[str, str | int | float | bool] | None:
    cards: dict[str, str | int | float | bool] = {}
    while True:
        block = handle.read(BLOCK)
        if len(block) < BLOCK:
            return None if not cards else cards
        for i in range(0, BLOCK, 80):
            card = block[i : i + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards
            if card[8:10] != "= ":
                continue
            text = card[10:].strip()
            if text.startswith("'"):
                cards[key] = re.match(r"'((?:[^']|'')*)'", text).group(1).replace("''", "'").rstrip()
                continue
            text = text.split("/")[0].strip()
            if text in ("T", "F"):
                cards[key] = text == "T"
            else:
                try:
                    cards[key] = int(text)
                except ValueError:
                    try:
                        cards[key] = float(text.replace("D", "E"))
                    except ValueError:
                        continue


def _data_bytes(cards) -> int:
    axes = [int(cards.get(f"NAXIS{i + 1}", 0)) for i in range(int(cards.get("NAXIS", 0)))]
    count = int(np.prod(axes, dtype=object)) if axes else 0
    size = abs(int(cards.get("BITPIX", 8))) // 8 * int(cards.get("GCOUNT", 1)) * (int(cards.get("PCOUNT", 0)) + count)
    return -(-size // BLOCK) * BLOCK


def read_table_header(path: str, hdu: int = 1) -> Table:
    """Layout of one binary table, from its header alone."""
    with open_file(path) as handle:
        at = 0
        while True:
            handle.seek(at)
            cards = _read_header(handle)
            if cards is None:
                raise ValueError(f"{path} has no HDU {hdu}.")
            start = handle.tell()
            if hdu == 0:
                break
            at, hdu = start + _data_bytes(cards), hdu - 1
    if cards.get("XTENSION") != "BINTABLE":
        raise ValueError(f"{path}: the chosen HDU is not a binary table.")
    fields, offset = [], 0
    for i in range(1, int(cards["TFIELDS"]) + 1):
        match = re.match(r"\s*(\d*)([LXBIJKAEDCM]|[PQ][LXBIJKAEDCM])", str(cards[f"TFORM{i}"]))
        if match is None:
            raise ValueError(f"{path}: unknown TFORM {cards[f'TFORM{i}']!r}.")
        repeat = int(match.group(1)) if match.group(1) else 1
        code, heap = match.group(2)[-1], match.group(2)[:-1]
        if code == "X" and not heap:
            repeat = -(-repeat // 8)
        size = {"": _CODES[code][0], "P": 8, "Q": 16}[heap]
        if repeat:
            name = str(cards.get(f"TTYPE{i}", f"col{i}"))
            scale, zero = float(cards.get(f"TSCAL{i}", 1)), float(cards.get(f"TZERO{i}", 0))
            fields.append(Field(name, offset, code, repeat, scale, zero, heap))
        offset += repeat * size
    width, rows = int(cards["NAXIS1"]), int(cards["NAXIS2"])
    return Table(tuple(fields), start, width, rows, start + int(cards.get("THEAP", width * rows)))


def _heap_column(field: Field, records: np.ndarray, handle, heap: int) -> pa.Array:
    """Variable-length column: descriptors in the rows, values in the heap, read in one stretch if dense."""
    kind, size = (">i4", 8) if field.heap == "P" else (">i8", 16)
    raw = np.ascontiguousarray(records[:, field.offset : field.offset + size])
    counts, starts = raw.view(kind).reshape(-1, 2).astype(np.int64).T
    width = _CODES[field.code][0]
    bytes_of = -(-counts // 8) if field.code == "X" else counts * width
    used = counts > 0
    total = int(bytes_of.sum())
    first = int(starts[used].min()) if used.any() else 0
    span = int((starts + bytes_of)[used].max()) - first if used.any() else 0
    if span <= 4 * total + (1 << 20):
        handle.seek(heap + first)
        block = handle.read(span)
        pieces = [block[s - first : s - first + b] for s, b in zip(starts.tolist(), bytes_of.tolist())]
    else:
        pieces = []
        for s, b in zip(starts.tolist(), bytes_of.tolist()):
            handle.seek(heap + s)
            pieces.append(handle.read(b))
    if field.code == "A":
        return pa.array([p.split(b"\0")[0].decode("utf-8", "replace").strip() for p in pieces], pa.string())
    flat = _values(field, np.frombuffer(b"".join(pieces), np.uint8))
    lengths = bytes_of if field.code == "X" else counts
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), flat)


def _column(field: Field, records: np.ndarray) -> pa.Array:
    """One column of a block of records (rows x bytes) as an Arrow array."""
    size = _CODES[field.code][0]
    raw = np.ascontiguousarray(records[:, field.offset : field.offset + size * field.repeat])
    n = len(raw)
    if field.code == "A":
        text = raw.view(f"S{field.repeat}").reshape(n)
        return pa.array([t.split(b"\0")[0].decode("utf-8", "replace").strip() for t in text.tolist()], pa.string())
    flat = _values(field, raw.reshape(-1))
    return flat if field.repeat == 1 else _lists(flat, field.repeat)


def _values(field: Field, raw: np.ndarray) -> pa.Array:
    """The bytes of any number of values of a field as one flat Arrow array."""
    if field.code == "L":
        return pa.array(raw == ord("T"), mask=(raw == 0))
    kind = _CODES[field.code][1]
    values = raw.view(kind)
    values = values.astype(values.dtype.newbyteorder("="))
    if field.code in "BIJK" and (field.scale != 1 or field.zero != 0):
        if field.shifted:
            values = values.astype(np.int64) + int(field.zero)
        else:
            values = values.astype(np.float64) * field.scale + field.zero
    if field.code in "CM":
        return _lists(pa.array(values).cast(_ARROW[_CODES[field.code][2][6:-1]]), 2)
    return pa.array(values).cast(_ARROW[field.element])


def _lists(flat: pa.Array, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)


class Rows(InputPartition):
    def __init__(self, path: str, table: Table, first: int, stop: int):
        self.path, self.table, self.first, self.stop = path, table, first, stop


class FitsReader(DataSourceReader):
    def __init__(self, tables: list[tuple[str, Table]], columns: list[str], chunk_rows: int, target_bytes: int):
        self.tables, self.columns = tables, columns
        self.chunk_rows, self.target_bytes = chunk_rows, target_bytes

    def partitions(self):
        parts = []
        for path, table in self.tables:
            step = rows_per_partition(self.chunk_rows, table.row_bytes, self.target_bytes)
            if path.endswith(".gz"):  # one compressed stream cannot be entered in the middle
                step = max(table.rows, 1)
            parts += [Rows(path, table, i, min(i + step, table.rows)) for i in range(0, table.rows, step)]
        return parts or [Rows("", self.tables[0][1], 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.stop:
            return
        table = partition.table
        fields = {f.name: f for f in table.fields}
        with open_file(partition.path) as handle:
            at, left = table.start + partition.first * table.row_bytes, partition.stop - partition.first
            while left:
                n = min(left, max(1, min(BATCH_ROWS, (8 << 20) // table.row_bytes)))
                handle.seek(at)
                block = handle.read(n * table.row_bytes)
                if len(block) != n * table.row_bytes:
                    raise ValueError(f"{partition.path} ends inside its table.")
                records = np.frombuffer(block, np.uint8).reshape(n, table.row_bytes)
                arrays = [
                    _heap_column(fields[c], records, handle, table.heap) if fields[c].heap else _column(fields[c], records)
                    for c in self.columns
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=self.columns)
                at, left = at + n * table.row_bytes, left - n


class FitsDataSource(DataSource):
    """``spark.read.format("fits")``; options path, hdu, columns, chunk_rows, target_bytes."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def _tables(self) -> list[tuple[str, Table]]:
        paths = [p for p in self.options["path"].split("\n") if p]
        hdu = int(self.options.get("hdu", 1))
        return [(p, read_table_header(p, hdu)) for p in paths]

    def _columns(self, table: Table) -> list[str]:
        wanted = self.options.get("columns")
        names = [f.name for f in table.fields]
        if not wanted:
            return names
        chosen = wanted.split("\n")
        absent = [c for c in chosen if c not in names]
        if absent:
            raise ValueError("FITS table misses columns: " + ", ".join(absent))
        return chosen

    def schema(self) -> str:
        table = self._tables()[0][1]
        types = {f.name: f.spark for f in table.fields}
        return ", ".join(f"`{c.replace('`', '``')}` {types[c]}" for c in self._columns(table))

    def reader(self, schema) -> DataSourceReader:
        tables = self._tables()
        layouts = {tuple((f.name, f.spark) for f in t.fields) for _, t in tables}
        if len(layouts) > 1:
            raise ValueError("FITS files read together must have the same columns; read and union them instead.")
        return FitsReader(
            tables,
            self._columns(tables[0][1]),
            int(self.options.get("chunk_rows", CHUNK_ROWS)),
            int(self.options.get("target_bytes", PARTITION_BYTES)),
        )


def expand(path: str) -> list[str]:
    """A FITS path, or the FITS files of a local folder."""
    if "://" not in path and os.path.isdir(path):
        names = sorted(n for n in os.listdir(path) if re.search(r"\.(fits|fit|fts)(\.gz)?$", n.lower()))
        return [os.path.join(path, n) for n in names]
    return [path]

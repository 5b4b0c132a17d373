"""Small helpers the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step inside a task works on.
SLICE_BYTES = 1_000_000
#: Bytes of one Arrow batch between Spark and a Python worker; Spark's own limit is 64 MB, which either side holds several times.
BATCH_BYTES = 4_000_000
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds about ``most`` bytes of text; one longer text is a piece of its own."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def give_back() -> None:
    """Return what this process has freed to the system. Arrow's and C's allocators keep it for later use."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kinds: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of at most BATCH_BYTES, unless the session sets a limit, and workers that hold little between tasks.

    Spark keeps its workers, idle ones too, so what a task leaves in them counts for an executor as long as it lives.
    The limit is a setting of the session, since a plan is run after this returns.
    """
    conf = df.sparkSession.conf
    if _BATCH_LIMIT not in conf.getAll:
        conf.set(_BATCH_LIMIT, str(BATCH_BYTES))

    def tidy(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, kinds)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null is the empty text."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Bytes of letters: A-Z, a-z and everything beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the buffer, and the first word of each text (n + 1).

    A word is ``[^\\x20\\x09-\\x0D]+``, or a run of the bytes marked by ``inside``.
    """
    inside = ~_SPACE[data] if inside is None else inside
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[cuts] = inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | start[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every \\n-split line of each text, empty lines too; the break is not part of a line."""
    breaks = np.flatnonzero(data == 10)
    text_of = np.searchsorted(offsets[1:], breaks, side="right")
    per_text = np.bincount(text_of, minlength=len(offsets) - 1) + 1
    last = np.cumsum(per_text) - 1
    ends = np.empty(len(breaks) + len(per_text), np.int64)
    ends[last] = offsets[1:]
    rest = np.ones(len(ends), bool)
    rest[last] = False
    ends[rest] = breaks
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    starts[last - per_text + 1] = offsets[:-1]
    return starts, ends, np.repeat(np.arange(len(per_text)), per_text)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64 over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes: differences of a running polynomial, taken back to the span's start."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data) + 1
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)]
    running = np.zeros(n, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + _ODD + np.uint64(seed << 8)) * _POWERS[0][: n - 1], out=running[1:])
    return mix((running[ends] - running[starts]) * _POWERS[1][starts] + (ends - starts).astype(np.uint64) * _ODD)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def boxed(df: DataFrame):
    """All columns of a row in one, so that names used inside an operator cannot clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")


def box_type(df: DataFrame, *more: tuple[str, str]) -> T.StructType:
    """Schema of a boxed row and further columns (name, type)."""
    out = T.StructType([T.StructField("_row", df.schema)])
    for name, kind in more:
        out = out.add(name, kind)
    return out


def bounded_sample(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids with their 0/1 labels, chosen by a hash of the id: the same choice at every run."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    one = usable.groupBy("doc_id").agg(F.max(column).cast("double").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

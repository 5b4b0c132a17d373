"""Session settings, shared scratch space and file helpers (all through Hadoop file systems)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skyloom", **conf: str) -> SparkSession:
    """A session with the settings the results are defined under.

    ``caseSensitive`` matters: catalogs often hold both ``Z`` and ``z``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.caseSensitive", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine: on a cluster
    other executors could not read it.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        base = tempfile.mkdtemp(prefix="skyloom-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Paths written in the open scopes of this thread, innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scratch scopes", default=())


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables written by ``as_table`` inside the block are deleted at its end, so nothing lazy that reads them may leave it.

    A table made with ``keep`` belongs to the scope around (and stays if there is none).
    """
    made: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in made:
            delete_path(spark, path)


def as_table(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Cut the lineage of a small derived table by writing it once to the shared folder.

    Unlike a cached block the files survive lost executors, and the optimizer
    knows their size, so it can decide by itself whether to broadcast them.
    """
    path = scratch_path(df.sparkSession, label)
    scopes = _SCOPES.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    fs.delete(p, True)


@contextmanager
def replacing(spark: SparkSession, path: str) -> Iterator[str]:
    """A sibling path to write to; it takes the place of ``path`` only if the block ends well.

    What was at ``path`` is moved aside, and deleted once the new data is in its place.
    After an error, or when a machine dies, the old data is there whole.
    """
    path, tag = path.rstrip("/"), uuid.uuid4().hex
    folder, slash, name = path.rpartition("/")
    staged, aside = (f"{folder}{slash}{name}.{kind}-{tag}" for kind in ("new", "old"))
    try:
        yield staged
        _, target, fs = _fs(spark, path)
        old, new = _fs(spark, aside)[1], _fs(spark, staged)[1]
        replaced = fs.exists(target)
        if replaced and not fs.rename(target, old):
            raise OSError(f"{path} could not be moved aside.")
        if not fs.rename(new, target):
            if replaced:
                fs.rename(old, target)
            raise OSError(f"{path} could not be put in place.")
        if replaced:
            fs.delete(old, True)
    finally:
        delete_path(spark, staged)


def within(spark: SparkSession, path: str, folder: str) -> bool:
    """Whether ``path`` is ``folder`` or lies in it."""

    def full(name: str) -> str:
        _, p, fs = _fs(spark, name.rstrip("/"))
        return fs.makeQualified(p).toString().rstrip("/") + "/"

    return full(path).startswith(full(folder))


def is_dir(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names directly below a folder."""
    _, p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> list[str]:
    """Sorted full paths of the files below a folder, at any depth; hidden ones are left out."""
    _, p, fs = _fs(spark, path)
    found, names = [], fs.listFiles(p, True)
    while names.hasNext():
        one = names.next().getPath()
        if one.getName().endswith(suffixes) and not one.getName().startswith(("_", ".")):
            found.append(one.toUri().toString())
    return sorted(found)


def total_bytes(spark: SparkSession, path: str) -> int:
    _, p, fs = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())


def read_text(spark: SparkSession, path: str) -> str | None:
    """Whole content of a small metadata file, or None if it does not exist."""
    jvm, p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, content: str) -> None:
    _, p, fs = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(content.encode("utf-8")))
    finally:
        stream.close()


def move_single_part(spark: SparkSession, folder: str, target: str) -> None:
    """Publish the only data file Spark wrote into ``folder`` under a fixed name."""
    jvm, p, fs = _fs(spark, folder)
    parts = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise RuntimeError(f"Expected one part file in {folder}, found {len(parts)}.")
    fs.rename(parts[0], jvm.org.apache.hadoop.fs.Path(target))
    fs.delete(p, True)

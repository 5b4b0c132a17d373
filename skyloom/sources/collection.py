"""Reading spatial catalogs and collections, with or without their margin cache."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.functions.expr import CatalogError, col
from skyloom.session import is_dir, list_names, read_text


def load_properties(spark: SparkSession, path: str) -> dict[str, str]:
    """A Java properties file as a mapping; empty if there is none."""
    text = read_text(spark, path)
    if text is None:
        return {}
    jvm = spark.sparkContext._jvm
    table = jvm.java.util.Properties()
    table.load(jvm.java.io.StringReader(text))
    return {str(k): str(table.getProperty(k)).strip() for k in table.stringPropertyNames()}


@dataclass(frozen=True)
class Catalog:
    """One tiled catalog: its folder and the facts of its properties."""

    folder: str
    facts: dict[str, str]

    @property
    def threshold(self) -> float:
        """Width of a margin catalog in arcseconds; NaN if it is not one."""
        try:
            return float(self.facts["hats_margin_threshold"])
        except (KeyError, ValueError):
            return math.nan


@dataclass(frozen=True)
class CollectionLayout:
    """What ``collection.properties`` says a folder holds; a bare catalog is a layout of itself alone."""

    spark: SparkSession
    root: str
    facts: dict[str, str]

    @classmethod
    def of(cls, spark: SparkSession, path: str) -> CollectionLayout:
        root = path.rstrip("/")
        return cls(spark, root, load_properties(spark, f"{root}/collection.properties"))

    def catalog(self, name: str) -> Catalog:
        """A member by its relative name or absolute place."""
        folder = name if name.startswith("/") or "://" in name else f"{self.root}/{name}".rstrip("/")
        return Catalog(folder, load_properties(self.spark, f"{folder}/hats.properties"))

    @property
    def primary(self) -> str:
        """Name of the main catalog: the one that is named, else this folder, else the customary ``catalog`` in it."""
        if named := self.facts.get("hats_primary_table_url"):
            return named
        customary = "" if self.catalog("").facts else "catalog"
        return customary if self.catalog(customary).facts else ""

    @property
    def margins(self) -> list[str]:
        """Names of the margin catalogs, the default one too if only that is named."""
        listed = self.facts.get("all_margins", "").replace(",", " ").split()
        default = self.facts.get("default_margin")
        return listed if default in (None, "", *listed) else [*listed, default]

    def margin(self, threshold: float | None = None) -> Catalog | None:
        """The margin of a threshold, or without one the default, else the narrowest."""
        known = {name: self.catalog(name) for name in self.margins}
        usable = {n: c for n, c in known.items() if not math.isnan(c.threshold)}
        if threshold is not None:
            usable = {n: c for n, c in usable.items() if math.isclose(c.threshold, threshold, abs_tol=1e-9)}
        best = min(usable, key=lambda n: (n != self.facts.get("default_margin"), usable[n].threshold), default=None)
        return usable.get(best)


def _read_leaves(spark: SparkSession, source: Catalog, columns: Sequence[str] | None, tiles: bool) -> DataFrame:
    """Tile number comes from the folder, or from the file where each tile is a single file."""
    catalog, facts = source.folder, source.facts
    leaves = [n for n in list_names(spark, f"{catalog}/dataset") if n.startswith("Norder=")]
    if not leaves:
        raise CatalogError(f"{catalog} holds no tiles.")
    paths = [f"{catalog}/dataset/{n}" for n in leaves]
    df = spark.read.option("basePath", f"{catalog}/dataset").parquet(*paths)
    if facts.get("hats_npix_suffix", "/") != "/" or "Npix" not in df.columns:
        number = F.regexp_extract(F.col("_metadata.file_name"), r"Npix=(\d+)", 1).cast("bigint")
        df = df.withColumn("Npix", number)
    df = df.withColumns({"Norder": F.col("Norder").cast("int"), "Npix": F.col("Npix").cast("bigint")})
    place = ["Norder", "Dir", "Npix"]
    names = list(columns) if columns else [c for c in df.columns if c not in place]
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise CatalogError("Catalog misses columns: " + ", ".join(absent) + ".")
    return df.select(*[col(n) for n in names], *(place if tiles else []))


def read_spatial(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, tiles: bool = False
) -> DataFrame:
    """Rows of a spatial catalog or of a collection's primary; ``tiles`` adds Norder, Dir, Npix."""
    layout = CollectionLayout.of(spark, path)
    return _read_leaves(spark, layout.catalog(layout.primary), columns, tiles)


def read_margin(
    spark: SparkSession,
    path: str,
    threshold: float | None = None,
    columns: Sequence[str] | None = None,
    tiles: bool = False,
) -> DataFrame | None:
    """Rows of the selected margin catalog, or None if the collection has none to offer."""
    margin = CollectionLayout.of(spark, path).margin(threshold)
    if margin is None:
        return None
    dataset = f"{margin.folder}/dataset"
    if not is_dir(spark, dataset) or not any(n.startswith("Norder=") for n in list_names(spark, dataset)):
        return read_spatial(spark, path, columns, tiles).limit(0)  # an empty margin has the primary's columns
    return _read_leaves(spark, margin, columns, tiles)

"""Spatial collections: a tiled primary catalog plus an optional margin cache."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.functions.expr import CatalogError
from skyloom.functions.healpix import INDEX_COLUMN, INDEX_ORDER, add_sky_index
from skyloom.operators.tiles import (
    MAX_ORDER,
    MAX_TILE_ROWS,
    TileMap,
    assign_tiles,
    build_tile_map,
    cells_below,
    cluster_tiles,
    count_cells,
    margin_rows,
    row_bytes,
)
from skyloom.operators.validate import check_spatial_coordinates, observed, spatial_metrics
from skyloom.session import as_table, move_single_part, path_exists, replacing, scratch_scope, write_text
from skyloom.sinks.parquet import check_output, write_manifest
from skyloom.sources.collection import CollectionLayout

DEFAULT_MARGIN_ARCSEC = 5.0
TILE_COLUMNS = ["Norder", "Dir", "Npix"]


def margin_name(name: str, threshold: float) -> str:
    return f"{name}_{threshold:g}arcs".replace(".", "_")


def _properties(title: str, values: dict[str, object]) -> str:
    return "\n".join([f"#{title}", *[f"{k}={v}" for k, v in values.items() if v is not None]]) + "\n"


def _write_leaves(df: DataFrame, path: str) -> None:
    df.write.partitionBy(*TILE_COLUMNS).parquet(f"{path}/dataset")


def _write_partition_info(tiles: DataFrame, path: str) -> None:
    folder = f"{path}/_partition_info"
    tiles.select("Norder", "Npix").orderBy("Norder", "Npix").coalesce(1).write.option("header", True).csv(folder)
    move_single_part(tiles.sparkSession, folder, f"{path}/partition_info.csv")


def _catalog_properties(
    name: str, kind: str, rows: int, ra: str, dec: str, tiles: TileMap, **extra: object
) -> dict[str, object]:
    return {
        "obs_collection": name,
        "dataproduct_type": kind,
        "hats_nrows": rows,
        "hats_col_ra": ra,
        "hats_col_dec": dec,
        "hats_col_healpix": INDEX_COLUMN,
        "hats_col_healpix_order": INDEX_ORDER,
        "hats_npix_suffix": "/",
        **extra,
        "hats_order": max(tiles.orders) if tiles.orders else 0,
        "hats_version": "v1.0",
    }


def write_collection(
    df: DataFrame,
    path: str,
    ra: str,
    dec: str,
    name: str | None = None,
    margin_arcsec: float | None = DEFAULT_MARGIN_ARCSEC,
    max_tile_rows: int = MAX_TILE_ROWS,
    max_order: int | None = None,
    sort_column: str | None = None,
    overwrite: bool = False,
    verify: Callable[[], None] | None = None,
    max_tile_bytes: int | None = None,
    default_columns: Sequence[str] | None = None,
    facts: dict[str, Any] | None = None,
) -> TileMap:
    """Write a catalog as tiles, each held by its own folder, and the rows around each tile.

    Two scans of the input: one reads the coordinates (and, for ``max_tile_bytes``, the
    lengths of texts), sizes the tiles and checks the ranges; one writes. The margin reads the
    written tiles, not the input again. ``verify`` is a check of the caller's own to run between
    them, ``facts`` a manifest to add. The collection takes its place when it is complete.

    Cells of ``MAX_ORDER`` with more than ``max_tile_rows`` take a scan more and are split as far as
    that needs; a ``max_order`` of the caller's own is kept to, and such cells are refused.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    title = path.rsplit("/", 1)[-1]
    name = name or title
    if margin_arcsec is not None and not margin_arcsec > 0:
        raise CatalogError("margin threshold must be positive; pass None to write no margin.")
    check_output(spark, path, overwrite)
    df = df.drop(INDEX_COLUMN, *TILE_COLUMNS)
    sized, ranges = observed(df, spatial_metrics(df, ra, dec))
    size = row_bytes(df) if max_tile_bytes is not None else None
    finest = MAX_ORDER if max_order is None else max_order
    cells = count_cells(add_sky_index(sized, ra, dec), finest, size)
    if verify is not None:
        verify()
    check_spatial_coordinates(ranges(), ra, dec)
    indexed = add_sky_index(df, ra, dec)
    finer = cells_below(indexed, size) if max_order is None else None
    tiles = build_tile_map(cells, max_tile_rows, finest, max_tile_bytes, strict=True, finer=finer)
    with replacing(spark, path) as staged:
        primary = f"{staged}/{name}"
        _write_leaves(cluster_tiles(assign_tiles(indexed, tiles), tiles, sort_column), primary)
        _write_schema(indexed, primary)
        _write_partition_info(tiles.table, primary)
        columns = ",".join(default_columns) if default_columns else None
        properties = _catalog_properties(
            name,
            "object",
            tiles.n_rows,
            ra,
            dec,
            tiles,
            hats_max_rows=max_tile_rows,
            hats_cols_sort=sort_column,
            hats_cols_default=columns,
        )
        write_text(spark, f"{primary}/hats.properties", _properties("HATS catalog", properties))
        margins = []
        if margin_arcsec is not None:
            margins.append(margin_name(name, margin_arcsec))
            _write_margin(spark, staged, name, margins[0], ra, dec, tiles, margin_arcsec)
        _write_collection_properties(spark, staged, title, name, margins, margins[0] if margins else None)
        if facts is not None:
            hats = {"catalog_name": name, "ra_column": ra, "dec_column": dec, "margin_threshold": margin_arcsec}
            extra = {"n_partitions": tiles.n_tiles, "hats": {**hats, "sort_columns": sort_column}}
            write_manifest(spark, staged, facts | extra)
    return tiles


def _write_collection_properties(
    spark: SparkSession, path: str, title: str, name: str, margins: Sequence[str], default: str | None
) -> None:
    values = {
        "obs_collection": title,
        "hats_primary_table_url": name,
        "all_margins": " ".join(margins) or None,
        "default_margin": default,
        "hats_version": "v1.0",
    }
    write_text(spark, f"{path}/collection.properties", _properties("HATS Collection", values))


def _write_schema(rows: DataFrame, catalog: str) -> None:
    """``dataset/_common_metadata``: the columns of the leaves, so that readers need not open one."""
    folder = f"{catalog}/_schema"
    rows.limit(0).coalesce(1).write.parquet(folder)
    move_single_part(rows.sparkSession, folder, f"{catalog}/dataset/_common_metadata")


def _write_margin(
    spark: SparkSession, path: str, name: str, margin: str, ra: str, dec: str, tiles: TileMap, threshold: float
) -> None:
    stored = spark.read.parquet(f"{path}/{name}/dataset")
    stored = stored.withColumns({"Norder": F.col("Norder").cast("int"), "Npix": F.col("Npix").cast("bigint")})
    rows = margin_rows(stored, tiles, ra, dec, threshold)
    _write_leaves(cluster_tiles(rows, tiles, counted=False), f"{path}/{margin}")
    # An empty margin leaves a folder without data files, which has no schema to read back.
    written = spark.read.schema(rows.schema).parquet(f"{path}/{margin}/dataset")
    found = as_table(written.groupBy("Norder", "Npix").agg(F.count(F.lit(1)).alias("n_rows")), "margin-tiles")
    _write_schema(rows.drop(*TILE_COLUMNS), f"{path}/{margin}")
    _write_partition_info(found, f"{path}/{margin}")
    facts = _catalog_properties(
        margin,
        "margin",
        found.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0],
        ra,
        dec,
        tiles,
        hats_primary_table_url=name,
        hats_margin_threshold=float(threshold),
    )
    write_text(spark, f"{path}/{margin}/hats.properties", _properties("HATS catalog", facts))


def add_margin(spark: SparkSession, path: str, threshold_arcsec: float) -> str:
    """Add a margin catalog to an existing collection and return its name; the default margin stays."""
    with scratch_scope(spark):
        return _add_margin(spark, path, threshold_arcsec)


def _add_margin(spark: SparkSession, path: str, threshold_arcsec: float) -> str:
    layout = CollectionLayout.of(spark, path)
    primary = layout.catalog(layout.primary)
    name = primary.folder.rsplit("/", 1)[-1]
    margin = margin_name(name, threshold_arcsec)
    if path_exists(spark, f"{layout.root}/{margin}"):
        raise CatalogError(f"{layout.root} has a margin named {margin} already.")
    leaves = spark.read.parquet(f"{primary.folder}/dataset")
    counts = leaves.groupBy(F.col("Norder").cast("int").alias("Norder"), F.col("Npix").cast("bigint").alias("Npix"))
    table = as_table(counts.agg(F.count(F.lit(1)).alias("n_rows")), "tiles")
    found = table.groupBy("Norder").agg(F.count(F.lit(1)).alias("t"), F.sum("n_rows").alias("n")).collect()
    orders = sorted(r["Norder"] for r in found)
    tiles = TileMap(table, orders, sum(r["t"] for r in found), sum(r["n"] for r in found), MAX_TILE_ROWS, max(orders, default=0))
    facts = primary.facts
    _write_margin(spark, layout.root, name, margin, facts["hats_col_ra"], facts["hats_col_dec"], tiles, threshold_arcsec)
    default = layout.facts.get("default_margin") or margin
    title = layout.facts.get("obs_collection", name)
    _write_collection_properties(spark, layout.root, title, name, [*layout.margins, margin], default)
    return margin

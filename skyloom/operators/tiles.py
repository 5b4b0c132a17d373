"""Adaptive sky tiles: partition map, row assignment, order inside a tile, margin rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from skyloom.functions.expr import CatalogError, col, require_columns
from skyloom.functions.healpix import (
    INDEX_COLUMN,
    INDEX_ORDER,
    add_face_xy,
    coarser,
    neighbourhood,
    tile_reach_udf,
)
from skyloom.session import as_table

MAX_ORDER = 10
# Orders a cell with too many rows is counted further down, in one more scan of the rows inside.
FINER_ORDERS = 5
MAX_TILE_ROWS = 1_000_000
# Neighbouring tiles of a margin in one task: they share rows, which makes the exchange smaller.
DEALT_TOGETHER = 4
# Fixed value: an angle on the sky is at least this share of the distance on the unit face (true bound 0.65).
MIN_STRETCH = 0.6


def row_bytes(df: DataFrame) -> Column:
    """Uncompressed bytes of a row: fixed widths, and the lengths of texts, binaries and lists of the row."""
    sizes, fixed = [], 0
    for field in df.schema.fields:
        kind, value = field.dataType, col(field.name)
        if isinstance(kind, (T.StringType, T.BinaryType)):
            sizes.append(F.octet_length(value))
        elif isinstance(kind, T.ArrayType) and hasattr(kind.elementType, "jsonValue"):
            sizes.append(F.greatest(F.size(value), F.lit(0)) * 8)
        else:
            fixed += 8
    return sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(fixed)).cast("long")


def occupied_cells(indexed: DataFrame, order: int = MAX_ORDER, size: Column | None = None) -> DataFrame:
    """(cell, n_rows, n_bytes) of every occupied cell; rows without a place on the sky count under NULL.

    n_bytes is 0 unless ``size`` tells the bytes of a row.
    """
    size = F.lit(0).cast("long") if size is None else size
    cell = coarser(F.col(INDEX_COLUMN), order).alias("cell")
    return indexed.groupBy(cell).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("n_bytes"))


def partition_map(
    cells: DataFrame,
    order: int = MAX_ORDER,
    max_rows: int = MAX_TILE_ROWS,
    max_bytes: int | None = None,
    coarsest: int = 0,
) -> DataFrame:
    """(Norder, Npix, n_rows): the coarsest tiles that hold at most ``max_rows`` and ``max_bytes``.

    A cell of the finest order stays one tile however full it is, and no tile is
    coarser than ``coarsest``. Every cell counts towards all its ancestors in one
    aggregation; ``cells`` should be a written table, as it is read twice.
    """
    ancestors = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(o).alias("Norder"),
                    F.shiftright("cell", 2 * (order - o)).alias("Npix"),
                    F.shiftright("cell", 2 * (order - o + 1)).alias("parent"),
                )
                for o in range(coarsest, order + 1)
            ]
        )
    )
    counts = (
        cells.where(F.col("cell").isNotNull())
        .select(ancestors.alias("a"), "n_rows", "n_bytes")
        .groupBy("a.Norder", "a.Npix", "a.parent")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
    )
    fits = F.col("n_rows") <= max_rows
    if max_bytes is not None:
        fits &= F.col("n_bytes") <= max_bytes
    full = counts.where(~fits).select((F.col("Norder") + 1).alias("child_order"), F.col("Npix").alias("full_parent"))
    split = (F.col("Norder") == F.col("child_order")) & (F.col("parent") == F.col("full_parent"))
    under_full = counts.join(full, split, "left_semi")
    roots = counts.where(F.col("Norder") == coarsest)
    tiles = roots.unionByName(under_full).where(fits | (F.col("Norder") == order))
    return tiles.select("Norder", "Npix", "n_rows")


@dataclass
class TileMap:
    """A partition map as a written table, with the facts plans depend on."""

    table: DataFrame
    orders: list[int]
    n_tiles: int
    n_rows: int
    max_rows: int
    max_order: int

    def ranges(self) -> pd.DataFrame:
        """Tiles in the order of the index, with the range of it (start, end) each covers.

        At most 12 * 4**max_order rows, and a few more for each cell of that order that had
        to be split further; it is sent to every task.
        """
        found = self.table.toPandas()
        width = 2 * (INDEX_ORDER - found["Norder"].to_numpy("int64"))
        found["start"] = found["Npix"].to_numpy("int64") << width
        found["end"] = found["start"] + (np.int64(1) << width)
        return found.sort_values("start", ignore_index=True)

    def tasks(self, wanted: int) -> tuple[pd.DataFrame, int]:
        """Tiles packed in index order into about ``wanted`` tasks of like size, and the number of tasks.

        A tile is whole in its task (first), unless it has more than ``max_rows``: then its rows
        are dealt over as many tasks (pieces) as it fills.
        """
        found = self.ranges()
        per_task = max(1, -(-self.n_rows // max(1, wanted)))
        large = found["n_rows"] > max(self.max_rows, per_task)
        found["pieces"] = np.where(large, -(-found["n_rows"] // max(self.max_rows, per_task)), 1)
        before = (found["n_rows"].cumsum() - found["n_rows"]) // per_task
        found["first"] = before + (found["pieces"] - 1).cumsum() - (found["pieces"] - 1)
        return found, int((found["first"] + found["pieces"]).max()) if len(found) else 1


def count_cells(indexed: DataFrame, max_order: int = MAX_ORDER, size: Column | None = None) -> DataFrame:
    """Occupied cells as a written table: one scan of the coordinates, at most 12 * 4^order rows."""
    return as_table(occupied_cells(indexed, max_order, size), "cells")


def build_tile_map(
    cells: DataFrame,
    max_rows: int = MAX_TILE_ROWS,
    max_order: int = MAX_ORDER,
    max_bytes: int | None = None,
    strict: bool = False,
    finer: Callable[[DataFrame, int, int], DataFrame] | None = None,
) -> TileMap:
    """Derive the tiles from ``count_cells``; every row must have a place on the sky.

    ``strict`` refuses a cell of the finest order with more than ``max_rows`` instead of keeping it whole.
    ``finer`` (see ``cells_below``) counts inside such cells, so that they are split at any order of the index first.
    """
    lost = cells.where(F.col("cell").isNull()).first()
    if lost is not None:
        raise CatalogError(f"{lost['n_rows']} rows have no coordinates and cannot be placed in a tile.")
    table = as_table(partition_map(cells, max_order, max_rows, max_bytes), "tiles")
    found, top = _tiles_by_order(table)
    while finer is not None and top["n_rows"] > max_rows and max_order < INDEX_ORDER:
        full = F.col("n_rows") > max_rows
        below = min(max_order + FINER_ORDERS, INDEX_ORDER)
        inside = finer(table.where(full).select(F.col("Npix").alias("__full")), max_order, below)
        split = partition_map(inside, below, max_rows, max_bytes, coarsest=max_order + 1)
        table, max_order = as_table(table.where(~full).unionByName(split), "tiles"), below
        found, top = _tiles_by_order(table)
    if strict and top["n_rows"] > max_rows:
        raise CatalogError(
            f"Cell {top['Npix']} of order {top['Norder']} holds {top['n_rows']} rows, more than the {max_rows} of a tile;"
            " raise max_order, or max_tile_rows if the rows share one place."
        )
    orders = sorted(r["Norder"] for r in found)
    return TileMap(table, orders, sum(r["t"] for r in found), sum(r["n"] for r in found), max_rows, max_order)


def _tiles_by_order(table: DataFrame) -> tuple[list[Row], Row]:
    """Count of tiles (t) and rows (n) of each order of a partition map, and its fullest tile."""
    fullest = F.max(F.struct("n_rows", "Norder", "Npix")).alias("top")
    found = table.groupBy("Norder").agg(F.count(F.lit(1)).alias("t"), F.sum("n_rows").alias("n"), fullest).collect()
    if not found:
        raise CatalogError("A spatial catalog needs at least one row.")
    return found, max(r["top"] for r in found)


def cells_below(
    indexed: DataFrame, size: Column | None = None
) -> Callable[[DataFrame, int, int], DataFrame]:
    """The count, as a written table, of cells of a lower order inside given ones: (cells, their order, lower order)."""

    def count(full: DataFrame, order: int, below: int) -> DataFrame:
        # Null-safe, though nothing is null here: a plain equality would be pushed below the index as a filter that repeats it.
        inside = indexed.join(full, coarser(F.col(INDEX_COLUMN), order).eqNullSafe(F.col("__full")))
        return count_cells(inside, below, size)

    return count


def tile_folder(npix: Column) -> Column:
    """Directory number a tile is filed under."""
    return (npix - npix % 10000).cast("bigint")


def assign_tiles(indexed: DataFrame, tiles: TileMap) -> DataFrame:
    """Add Norder, Dir and Npix of each row's tile.

    Tiles are disjoint ranges of the index, so a binary search in their sorted
    starts finds a row's tile (Arrow batches of the index alone). Nothing of the
    catalog moves, at any number of tiles.
    """
    found = tiles.ranges()
    orders = found["Norder"].to_numpy("int32")
    shared = indexed.sparkSession.sparkContext.broadcast((found["start"].to_numpy(), found["end"].to_numpy(), orders))

    @F.pandas_udf("int")
    def order_of(index: pd.Series) -> pd.Series:
        starts, ends, orders = shared.value
        value = index.fillna(-1).to_numpy("int64")
        at = np.maximum(np.searchsorted(starts, value, side="right") - 1, 0)
        inside = (value >= starts[at]) & (value < ends[at])
        return pd.Series(orders[at]).where(pd.Series(inside))

    kept = [col(c) for c in indexed.columns]
    placed = indexed.select(*kept, order_of(F.col(INDEX_COLUMN)).alias("Norder"))
    npix = F.expr(f"shiftright(`{INDEX_COLUMN}`, 2 * ({INDEX_ORDER} - Norder))")
    return placed.select(*kept, "Norder", tile_folder(npix).alias("Dir"), npix.alias("Npix"))


def cluster_tiles(
    assigned: DataFrame, tiles: TileMap, sort_column: str | None = None, counted: bool = True
) -> DataFrame:
    """Bring the rows of a tile together, ordered by ``sort_column`` and position.

    The counts are known, so tiles are packed whole into tasks of like size, in index
    order; only one beyond the map's limit, such as a patch of sky with a third
    of the catalog, is dealt over several tasks by a hash of the row. One exchange.

    Rows that the map has not ``counted``, such as margins, have their tiles dealt out a few at a time:
    those with many rows lie side by side, and packed by the map's counts one task would get them all.
    """
    if sort_column is not None:
        require_columns(assigned, [sort_column], "tile sort")
    inner = [sort_column, INDEX_COLUMN] if sort_column else [INDEX_COLUMN]
    spark = assigned.sparkSession
    found, n_tasks = tiles.tasks(int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not counted:
        found["first"], found["pieces"] = np.arange(len(found)) // DEALT_TOGETHER % n_tasks, 1
    shared = spark.sparkContext.broadcast(tuple(found[c].to_numpy("int64") for c in ("start", "first", "pieces")))

    @F.pandas_udf("int")
    def task_of(start: pd.Series, salt: pd.Series) -> pd.Series:
        starts, first, pieces = shared.value
        at = np.maximum(np.searchsorted(starts, start.to_numpy("int64"), side="right") - 1, 0)
        return pd.Series(first[at] + salt.to_numpy("int64") % pieces[at])

    start = F.expr(f"shiftleft(Npix, 2 * ({INDEX_ORDER} - Norder))")
    salt = F.xxhash64(*[col(c) for c in assigned.columns]).bitwiseAND((1 << 62) - 1)
    together = assigned.withColumn("__task", task_of(start, salt)).repartitionById(n_tasks, F.col("__task"))
    return together.drop("__task").sortWithinPartitions("Norder", "Dir", "Npix", *[col(c) for c in inner])


def margin_rows(assigned: DataFrame, tiles: TileMap, ra: str, dec: str, threshold_arcsec: float) -> DataFrame:
    """Rows within the threshold of a tile they do not belong to, once per such tile.

    Norder, Dir and Npix of the result name the neighbour tile. Integer
    arithmetic on the index drops the rows too far from their tile's edge; the
    cells around the rest, too wide to be jumped over, name every tile in reach;
    the exact angle to each then decides.
    """
    if not threshold_arcsec > 0:
        raise CatalogError("margin threshold must be a positive number of arcseconds.")
    reach = math.radians(threshold_arcsec / 3600.0)
    if reach > MIN_STRETCH:
        raise CatalogError("margin threshold is larger than a base tile.")
    order = min(INDEX_ORDER, int(math.floor(math.log2(MIN_STRETCH / reach))))
    kept = [col(c) for c in assigned.columns if c not in ("Norder", "Dir", "Npix")]

    split = add_face_xy(assigned)
    steps = math.ceil(reach / MIN_STRETCH * (1 << INDEX_ORDER)) + 1
    side = F.expr(f"shiftleft(1L, {INDEX_ORDER} - Norder)")
    last = side - 1

    def near(axis: str) -> Column:
        """Within reach of either end of the axis; names the (long) position expression once."""
        return F.abs(F.col(axis).bitwiseAND(last) * 2 - last) >= last - 2 * steps

    edge = split.where(near("__x") | near("__y"))

    def shifted(c: str) -> Column:
        return F.shiftright(c, INDEX_ORDER - order)

    cells = neighbourhood(F.col("__face"), shifted("__x"), shifted("__y"), order)
    key_orders = sorted({min(o, order) for o in tiles.orders})

    def keys_of(cell: Column) -> Column:
        return F.array(
            *[
                F.struct(F.lit(o).alias("o"), F.shiftright(cell, 2 * (order - o)).alias("p"))
                for o in key_orders
            ]
        )

    keys = F.array_distinct(F.flatten(F.transform(cells, keys_of)))
    around = edge.select(
        *kept, F.col("Norder").alias("__own_order"), F.col("Npix").alias("__own_pix"), F.explode(keys).alias("__key")
    ).where(~((F.col("__key.o") == F.col("__own_order")) & (F.col("__key.p") == F.col("__own_pix"))))
    key_order = F.least(F.col("Norder"), F.lit(order))
    lookup = tiles.table.select(
        "Norder",
        "Npix",
        key_order.alias("__ko"),
        F.expr(f"shiftright(Npix, 2 * greatest(Norder - {order}, 0))").alias("__kp"),
        F.expr("shiftright(Npix, 2 * Norder)").alias("__tile_face"),
    )
    # Position of the tile on its face: the even and odd bits of its number inside the face.
    lookup = lookup.withColumn("__inner", F.expr("Npix & (shiftleft(1L, 2 * Norder) - 1L)"))
    lookup = add_face_xy(lookup, "__inner", INDEX_ORDER).drop("__face", "__inner")
    lookup = lookup.withColumnsRenamed({"__x": "__tile_x", "__y": "__tile_y"})
    pairs = around.join(
        lookup, (F.col("__key.o") == F.col("__ko")) & (F.col("__key.p") == F.col("__kp"))
    ).where((F.col("Norder") != F.col("__own_order")) | (F.col("Npix") != F.col("__own_pix")))
    within = tile_reach_udf(reach)(
        col(ra).cast("double"), col(dec).cast("double"), "Norder", "__tile_face", "__tile_x", "__tile_y"
    )
    return pairs.where(within).select(
        *kept, F.col("Norder"), tile_folder(F.col("Npix")).alias("Dir"), F.col("Npix")
    )

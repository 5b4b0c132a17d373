"""Footprint curves: usability, vertex order, and splitting where RA wraps around."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.functions.expr import CatalogError, finite
from skyloom.operators.quality import sky_x
from skyloom.session import as_table

# Column sets that identify the two footprint formats.
REGION_COLUMNS = ("region_id", "ring_type", "vertex_id", "ra_deg", "dec_deg")
LIMIT_COLUMNS = ("ra_center", "dec_limit")

#: Points of a block, about.
VERTEX_BLOCK = 100_000


def footprint_format(columns: list[str], expected: str | None = None) -> str:
    """Format of a footprint by its columns; it must be the configured one if there is one."""
    if set(REGION_COLUMNS) <= set(columns):
        found = "region_vertices"
    elif set(LIMIT_COLUMNS) <= set(columns):
        found = "declination_limit"
    else:
        raise CatalogError("Footprint has unsupported columns: " + ", ".join(sorted(columns)) + ".")
    if expected is not None and expected != found:
        raise CatalogError(f"Configured footprint format {expected!r} does not match detected format {found!r}.")
    return found


def footprint_curves(vertices: DataFrame) -> DataFrame:
    """(curve, position, ra, dec): the vertices to draw, whatever the format. ``position`` orders the points of a curve."""
    kind = footprint_format(vertices.columns)
    if kind == "region_vertices":
        position = F.col("vertex_id").cast("double")
        exterior = vertices.where((F.col("ring_type") == "exterior") & F.col("region_id").isNotNull())
        curve, ra, dec, source = F.col("region_id").cast("string"), "ra_deg", "dec_deg", exterior
    else:
        position = F.col("ra_center").cast("double")
        curve, ra, dec, source = F.lit("limit"), "ra_center", "dec_limit", vertices
    return source.select(
        curve.alias("curve"),
        position.alias("position"),
        F.col(ra).cast("double").alias("ra"),
        F.col(dec).cast("double").alias("dec"),
    )


def _along() -> list[Column]:
    """Order of the points of a curve: by position, those without one last, ties by place on the sky."""
    return [F.col("position").asc_nulls_last(), F.col("ra"), F.col("dec")]


def blocked_curves(vertices: DataFrame) -> DataFrame:
    """The points of ``footprint_curves`` with a block: stretches of like size that follow the order of a curve.

    Blocks are ranges of (curve, order) with sampled bounds, so their size does not depend on how
    positions are spread. They are written once, since two runs may sample other bounds.
    """
    points = footprint_curves(vertices)
    blocks = math.ceil(points.count() / VERTEX_BLOCK)
    if blocks <= 1:
        return points.withColumn("block", F.lit(0))
    ranged = points.repartitionByRange(blocks, F.col("curve"), *_along())
    return as_table(ranged.withColumn("block", F.spark_partition_id()), "curve-blocks")


def curve_usable(vertices: DataFrame) -> DataFrame:
    """One row: does any curve have at least two finite points?"""
    points = footprint_curves(vertices)
    ok = finite(points["ra"]) & finite(points["dec"])
    per_curve = points.groupBy("curve").agg(F.count_if(ok).alias("n"))
    return per_curve.agg(F.coalesce(F.max("n") >= 2, F.lit(False)).alias("usable"))


def ordered_curves(vertices: DataFrame) -> DataFrame:
    """Curve points with their 1-based place along the curve."""
    points = blocked_curves(vertices)
    local = F.row_number().over(Window.partitionBy("curve", "block").orderBy(*_along()))
    ranked = points.withColumn("place", local)
    sizes = points.groupBy("curve", "block").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("curve").orderBy("block")) - F.col("size")
    offsets = sizes.select("curve", "block", before.alias("offset"))
    return ranked.join(offsets, ["curve", "block"]).select(
        "curve", (F.col("offset") + F.col("place")).alias("place"), "ra", "dec"
    )


def curve_segments(vertices: DataFrame) -> DataFrame:
    """(curve, segment, position, x, y): drawable stretches, cut where x jumps by more than pi.

    Stretches of one point are dropped. Neighbours and jump counts are found
    block by block; a summary row per block carries them across, so a curve
    with most of the vertices is still spread over many tasks.
    """

    def present(c: Column) -> Column:
        """A missing coordinate is NaN here, so that NULL can mean "no neighbour"."""
        return F.coalesce(c, F.lit(math.nan))

    points = blocked_curves(vertices).withColumns({"x": present(sky_x(F.col("ra"))), "y": F.radians("dec")})
    inside = Window.partitionBy("curve", "block").orderBy(*_along())

    def jump(a: Column, b: Column) -> Column:
        step = F.abs(a - b)
        return F.coalesce((step > F.lit(math.pi)) & ~F.isnan(step), F.lit(False))

    local = points.select(
        "*",
        F.lag("x").over(inside).alias("prev_x"),
        F.lead("x").over(inside).alias("next_x"),
        F.row_number().over(inside).alias("row"),
        F.count(F.lit(1)).over(Window.partitionBy("curve", "block")).alias("size"),
    )
    local = local.withColumn("cut", jump(F.col("x"), F.col("prev_x")).cast("bigint"))
    local = local.withColumn("cuts", F.sum("cut").over(inside))
    along = Window.partitionBy("curve").orderBy("block")
    blocks = local.groupBy("curve", "block").agg(
        F.max("cuts").alias("inner"), F.min_by("x", "row").alias("head"), F.max_by("x", "row").alias("tail")
    )
    blocks = blocks.select(
        "curve",
        "block",
        "inner",
        F.lag("tail").over(along).alias("before"),
        F.lead("head").over(along).alias("after"),
        F.col("head"),
    ).withColumn("seam", jump(F.col("head"), F.col("before")).cast("bigint"))
    start = F.sum(F.col("inner") + F.col("seam")).over(along) - F.col("inner")
    blocks = blocks.select("curve", "block", "before", "after", start.alias("start"))
    joined = local.join(blocks, ["curve", "block"])
    first, last = F.col("row") == 1, F.col("row") == F.col("size")
    left = F.when(first, F.col("before")).otherwise(F.col("prev_x"))
    right = F.when(last, F.col("after")).otherwise(F.col("next_x"))

    def linked(other: Column) -> Column:
        return other.isNotNull() & ~jump(F.col("x"), other)

    return joined.where(linked(left) | linked(right)).select(
        "curve", (F.col("start") + F.col("cuts")).alias("segment"), "position", F.nanvl("x", F.lit(None)).alias("x"), "y"
    )


def unusable_footprint_warning(vertices: DataFrame, label: str) -> DataFrame:
    """A warning row if the footprint cannot be drawn."""
    message = f"{label}: footprint has no curve with at least two finite points."
    return (
        curve_usable(vertices)
        .where(~F.col("usable"))
        .select(
            F.lit("unusable_footprint").alias("code"),
            F.lit(None).cast("string").alias("column"),
            F.lit(message).alias("message"),
        )
    )

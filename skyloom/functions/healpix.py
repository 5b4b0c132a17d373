"""Nested equal-area sky index (Gorski et al. 2005) as column arithmetic.

The index is built in several projections because each step uses the previous
one more than once; Spark keeps them in one code-generated stage. Bits are
interleaved a byte at a time through a constant table: the usual shift-and-mask
chain doubles the expression at every step once a filter on the index is pushed
through the projections.
"""

from __future__ import annotations

from typing import Iterator, Tuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from skyloom.functions import tile_distance
from skyloom.functions.expr import col

# Task code travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(tile_distance)

INDEX_ORDER = 29
INDEX_COLUMN = "_healpix_29"


def _spread_number(v: int) -> int:
    """Move bit i of a number to bit 2i."""
    return sum(((v >> i) & 1) << (2 * i) for i in range(v.bit_length()))


def _even_bits(v: int) -> int:
    """Move bit 2i of a number to bit i, dropping the odd bits."""
    return sum(((v >> (2 * i)) & 1) << i for i in range(v.bit_length()))


_BYTE_SPREAD = [_spread_number(v) for v in range(256)]
_BYTE_EVEN = [_even_bits(v) for v in range(256)]


def _table(numbers: list[int]) -> str:
    """Constant array; written as text so that the optimizer handles one node, not one per number."""
    return f"cast(split('{' '.join(map(str, numbers))}', ' ') as array<bigint>)"


def _spread(v: str, bits: int) -> str:
    """Bit i of an expression to bit 2i, for the low ``bits`` bits."""
    table = _table(_BYTE_SPREAD)
    parts = [
        f"shiftleft(get({table}, cast(shiftright({v}, {8 * i}) & 255L as int)), {16 * i})"
        for i in range((bits + 7) // 8)
    ]
    return "(" + " + ".join(["0L", *parts]) + ")"


def _compress(v: str, bits: int) -> str:
    """Bit 2i of an expression to bit i, for the low ``bits`` bit pairs."""
    table = _table(_BYTE_EVEN)
    parts = [
        f"shiftleft(get({table}, cast(shiftright({v}, {8 * i}) & 255L as int)), {4 * i})"
        for i in range((bits + 3) // 4)
    ]
    return "(" + " + ".join(["0L", *[f"cast({p} as bigint)" for p in parts]]) + ")"


def _with(df: DataFrame, kept: list[Column], **expressions: str) -> DataFrame:
    """Keep some columns and add others given as SQL text (one parse each is much cheaper to plan)."""
    return df.select(*kept, *[F.expr(e).alias(n) for n, e in expressions.items()])


def add_sky_index(
    df: DataFrame, ra: str, dec: str, order: int = INDEX_ORDER, name: str = INDEX_COLUMN
) -> DataFrame:
    """Add the nested index of (ra, dec) in degrees; NULL where a coordinate is missing."""
    n, last = f"{1 << order}D", f"{(1 << order) - 1}L"
    kept = [col(c) for c in df.columns if c != name]
    step = df.select(
        *kept,
        F.nanvl(col(ra).cast("double"), F.lit(None).cast("double")).alias("__ra"),
        F.radians(F.nanvl(col(dec).cast("double"), F.lit(None).cast("double"))).alias("__dec"),
    )
    step = _with(step, kept, __z="sin(__dec)", __c="cos(__dec)", __t="pmod(__ra, 360D) / 90D")
    step = _with(
        step,
        kept,
        __z="__z",
        __t="__t",
        # Radius on the polar facet; next to a pole the cosine is the precise way to it.
        __r=f"if(abs(__z) < 0.99D, {n} * sqrt(3D * (1D - abs(__z))), {n} * __c / sqrt((1D + abs(__z)) / 3D))",
        __q="least(3L, floor(__t))",
        __u=f"floor({n} * (0.5D + __t) - 0.75D * {n} * __z)",
        __v=f"floor({n} * (0.5D + __t) + 0.75D * {n} * __z)",
    )
    step = _with(
        step,
        kept,
        __z="__z",
        __q="__q",
        __u="__u",
        __v="__v",
        __fu=f"shiftright(__u, {order})",
        __fv=f"shiftright(__v, {order})",
        __a=f"least(floor((__t - cast(__q as double)) * __r), {last})",
        __b=f"least(floor((1D - (__t - cast(__q as double))) * __r), {last})",
    )
    belt = "abs(__z) <= 2D / 3D"
    step = _with(
        step,
        kept,
        # least() skips NULLs, so a missing coordinate has to be passed on here.
        __f=f"""case when __u is null then null when {belt} then case when __fu = __fv then __fu | 4L when __fu < __fv then __fu else __fv + 8L end
            when __z >= 0 then __q else __q + 8L end""",
        __x=f"case when {belt} then __v & {last} when __z >= 0 then {last} - __b else __a end",
        __y=f"case when {belt} then {last} - (__u & {last}) when __z >= 0 then {last} - __a else __b end",
    )
    index = f"shiftleft(__f, {2 * order}) + {_spread('__x', order)} + shiftleft({_spread('__y', order)}, 1)"
    return step.select(*kept, F.expr(f"if(__x is null or __y is null, null, {index})").alias(name))


def coarser(index: Column, order: int, index_order: int = INDEX_ORDER) -> Column:
    """The cell of a lower order that holds an index."""
    return F.shiftright(index, 2 * (index_order - order))


def add_face_xy(df: DataFrame, index: str = INDEX_COLUMN, order: int = INDEX_ORDER) -> DataFrame:
    """Split an index into ``__face``, ``__x``, ``__y``."""
    inner = f"(`{index}` & {(1 << (2 * order)) - 1}L)"
    return _with(
        df,
        [col(c) for c in df.columns],
        __face=f"shiftright(`{index}`, {2 * order})",
        __x=_compress(inner, order),
        __y=_compress(f"shiftright({inner}, 1)", order),
    )


def _spread_once(v: Column) -> Column:
    """Spread bits with a single use of ``v``: its binary digits read as base 4 (for use inside lambdas)."""
    return F.conv(F.bin(v), 4, 10).cast("bigint")


def neighbour(face: Column, x: Column, y: Column, n: int) -> Column:
    """Struct (f, x, y) of the cell at in-face position (x, y), which may lie one step off the face.

    Faces 0-3 are the northern, 4-7 the equatorial, 8-11 the southern row. x
    grows to the north-east, y to the north-west. NULL where only three faces
    meet and the diagonal cell does not exist.
    """
    size = F.lit(n).cast("bigint")
    row, at = F.floor(face / 4).cast("int"), face % 4

    def cell(f: Column, cx: Column, cy: Column) -> Column:
        return F.struct(f.cast("bigint").alias("f"), cx.cast("bigint").alias("x"), cy.cast("bigint").alias("y"))

    def ring(base: int, turn: int) -> Column:
        return (at + turn) % 4 + base

    over_x, over_y, under_x, under_y = x >= size, y >= size, x < 0, y < 0
    inside_x, inside_y = ~over_x & ~under_x, ~over_y & ~under_y
    mirror_x, mirror_y = 2 * size - 1 - x, 2 * size - 1 - y
    north = (
        F.when(over_x & over_y, cell(ring(0, 2), mirror_x, mirror_y))
        .when(under_x & under_y, cell(at + 8, x + size, y + size))
        .when(over_x & inside_y, cell(ring(0, 1), y, mirror_x))
        .when(over_y & inside_x, cell(ring(0, 3), mirror_y, x))
        .when(under_x & inside_y, cell(at + 4, x + size, y))
        .when(under_y & inside_x, cell(ring(4, 1), x, y + size))
    )
    belt = (
        F.when(over_x & under_y, cell(ring(4, 1), x - size, y + size))
        .when(under_x & over_y, cell(ring(4, 3), x + size, y - size))
        .when(over_x & inside_y, cell(at, x - size, y))
        .when(over_y & inside_x, cell(ring(0, 3), x, y - size))
        .when(under_x & inside_y, cell(ring(8, 3), x + size, y))
        .when(under_y & inside_x, cell(at + 8, x, y + size))
    )
    south = (
        F.when(under_x & under_y, cell(ring(8, 2), -1 - x, -1 - y))
        .when(over_x & over_y, cell(at, x - size, y - size))
        .when(over_x & inside_y, cell(ring(4, 1), x - size, y))
        .when(over_y & inside_x, cell(at + 4, x, y - size))
        .when(under_x & inside_y, cell(ring(8, 3), y, -1 - x))
        .when(under_y & inside_x, cell(ring(8, 1), -1 - y, x))
    )
    return (
        F.when(inside_x & inside_y, cell(face, x, y))
        .when(row == 0, north)
        .when(row == 1, belt)
        .otherwise(south)
    )


def neighbourhood(face: Column, x: Column, y: Column, order: int) -> Column:
    """Array of the nested numbers of a cell and the up to eight cells around it."""
    offsets = F.array(
        *[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    )
    places = F.transform(offsets, lambda o: F.struct((x + o["dx"]).alias("x"), (y + o["dy"]).alias("y")))
    cells = F.transform(places, lambda p: neighbour(face, p["x"], p["y"], 1 << order))
    numbers = F.transform(
        F.array_compact(cells),
        lambda c: F.shiftleft(c["f"], 2 * order) + _spread_once(c["x"]) + F.shiftleft(_spread_once(c["y"]), 1),
    )
    return F.array_distinct(numbers)


def tile_reach_udf(reach: float):
    """Pandas UDF (ra, dec, order, face, x, y) -> whether the tile is within ``reach`` radians, Arrow batch by batch."""
    within = tile_distance.within_reach

    def run(batches: Iterator[Tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for ra, dec, order, face, x, y in batches:
            args = [np.asarray(s, dtype=np.float64) for s in (ra, dec)]
            whole = [np.asarray(s, dtype=np.int64) for s in (order, x, y, face)]
            yield pd.Series(within(*args, *whole, reach))

    return F.pandas_udf(run, "boolean")

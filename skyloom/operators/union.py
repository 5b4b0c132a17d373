"""Several sources as one catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from skyloom.functions.expr import CatalogError, col

# Widening order of the numeric types; two different ones meet at the later of them.
_INTEGERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


# Decimal digits that every value of an integer type fits in.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def check_same_columns(frames: Mapping[str, DataFrame] | Sequence[DataFrame]) -> None:
    """Every source must have the first one's column names in the same order (types may differ)."""
    named = frames if isinstance(frames, Mapping) else {f"source {i}": f for i, f in enumerate(frames)}
    first = next(iter(named.values())).columns
    if all(f.columns == first for f in named.values()):
        return
    lines = ["All sources must have the same schema, in the same order:"]
    lines += [f"{name}: {', '.join(f.columns)}" for name, f in named.items()]
    raise CatalogError("\n".join(lines))


def common_type(types: Sequence[T.DataType]) -> T.DataType:
    """Type that holds every source's values; text if they have nothing in common.

    Integers and decimals meet in a decimal with room for both. Next to floats all become
    doubles, which hold integers up to 2**53 unchanged.
    """
    distinct = [t for i, t in enumerate(types) if t not in types[:i] and not isinstance(t, T.NullType)]
    if len(distinct) <= 1:
        return distinct[0] if distinct else T.StringType()
    if all(type(t) in _INTEGERS for t in distinct):
        return max(distinct, key=lambda t: _INTEGERS.index(type(t)))
    exact = [T.DecimalType(_DIGITS[type(t)], 0) if type(t) in _DIGITS else t for t in distinct]
    if all(isinstance(t, T.DecimalType) for t in exact):
        scale = max(t.scale for t in exact)
        whole = max(t.precision - t.scale for t in exact)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if all(isinstance(t, T.NumericType) for t in distinct):
        return T.DoubleType()
    return T.StringType()


def _aligned(frame: DataFrame, names: Sequence[str], types: Mapping[str, T.DataType]) -> DataFrame:
    def value(name: str):
        source = col(name) if name in frame.columns else F.lit(None)
        return source.cast(types[name]).alias(name)

    return frame.select(*[value(n) for n in names])


def _union(frames: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    types = {n: common_type([f.schema[n].dataType for f in frames if n in f.columns]) for n in names}
    return reduce(DataFrame.union, [_aligned(f, names, types) for f in frames])


def union_strict(frames: Mapping[str, DataFrame] | Sequence[DataFrame]) -> DataFrame:
    """All rows of sources with identical ordered column names."""
    check_same_columns(frames)
    listed = list(frames.values()) if isinstance(frames, Mapping) else list(frames)
    return _union(listed, listed[0].columns)


def union_outer(frames: Mapping[str, DataFrame] | Sequence[DataFrame]) -> DataFrame:
    """All rows of all sources; columns in first-seen order, NULL where a source lacks one."""
    listed = list(frames.values()) if isinstance(frames, Mapping) else list(frames)
    return _union(listed, list(dict.fromkeys(c for f in listed for c in f.columns)))

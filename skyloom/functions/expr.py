"""Column helpers shared by every operator.

The source catalogs know one "missing" value; Spark has two (NULL and NaN).
All predicates and aggregates of this package go through the helpers below so
that both count as missing, and so that a comparison with a missing value is
never true.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The domain limits of a curated catalog.
RA_MIN_DEG = 0.0
RA_MAX_DEG = 360.0
DEC_MIN_DEG = -90.0
DEC_MAX_DEG = 90.0
Z_MIN = -0.1
Z_MIN_NO_BLUESHIFT = 0.0
Z_MAX = 20.0
INVALID_Z = -1.0
SPEED_OF_LIGHT_KMS = 299792.458

# Names of dtypes a ``cast`` accepts and the Spark type of each.
DTYPES = {
    "float": "double",
    "float64": "double",
    "Float64": "double",
    "float32": "float",
    "Float32": "float",
    "int": "bigint",
    "int64": "bigint",
    "Int64": "bigint",
    "int32": "int",
    "Int32": "int",
    "int16": "smallint",
    "Int16": "smallint",
    "int8": "tinyint",
    "Int8": "tinyint",
    "bool": "boolean",
    "boolean": "boolean",
    "str": "string",
    "string": "string",
    "object": "string",
    "category": "string",
    "datetime64[ns]": "timestamp",
}


class CatalogError(ValueError):
    """A catalog, or the request made of it, cannot be processed safely."""


def col(name: str) -> Column:
    """Column reference that survives dots and spaces in catalog names."""
    return F.col("`" + name.replace("`", "``") + "`")


def ordered_unique(names: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(names))


def require_columns(df: DataFrame, names: Iterable[str], context: str) -> None:
    """Fail early, naming every column of ``names`` that ``df`` lacks."""
    missing = [n for n in ordered_unique(names) if n not in df.columns]
    if missing:
        raise CatalogError(f"{context} references missing columns: {', '.join(missing)}.")


def spark_type(dtype: str) -> str:
    try:
        return DTYPES[dtype]
    except KeyError:
        raise CatalogError(f"Unsupported dtype: {dtype!r}.") from None


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_categorical(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.BooleanType))


def missing(c: Column, dtype: T.DataType) -> Column:
    """True where the value is NULL or NaN; never NULL itself."""
    return (c.isNull() | F.isnan(c)) if is_float(dtype) else c.isNull()


def clean(c: Column, dtype: T.DataType) -> Column:
    """The value with NaN folded into NULL, so that aggregates skip it."""
    return F.when(~F.isnan(c), c) if is_float(dtype) else c


def as_number(df: DataFrame, name: str) -> Column:
    """Double view of a column; text that is no number becomes NULL, as does NaN."""
    dtype = type_of(df, name)
    c = col(name)
    if is_float(dtype):
        return clean(c, dtype).cast("double")
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(dtype, T.StringType):
        v = number_from_text(c)
        return F.when(~F.isnan(v), v)
    return F.lit(None).cast("double")


# Fixed value: the shape of a number in text.
_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


def number_from_text(c: Column) -> Column:
    """Text to double, NULL where it is no number.

    The pattern goes first: a failed conversion costs the JVM an exception, and
    a successful one would accept suffixes such as ``1d``.
    """
    t = F.trim(c)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def finite(v: Column) -> Column:
    """True for a present, non-NaN, non-infinite double; never NULL."""
    return F.coalesce(F.abs(v) < F.lit(math.inf), F.lit(False))


def z_range(allow_blueshifts: bool) -> tuple[float, float]:
    return (Z_MIN if allow_blueshifts else Z_MIN_NO_BLUESHIFT), Z_MAX


def valid_z(v: Column, allow_blueshifts: bool = True) -> Column:
    """Redshift inside the open valid range. NULL for NULL, false for NaN (NaN is above 20)."""
    low, high = z_range(allow_blueshifts)
    return (v > F.lit(low)) & (v < F.lit(high))


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

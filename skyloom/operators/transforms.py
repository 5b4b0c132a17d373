"""The ten declarative column transformations and their pipeline.

Every transformation is a mapping with a ``type`` key; each turns into plain
column expressions on the lazy DataFrame, so a whole pipeline is one projection.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from skyloom.functions.expr import (
    INVALID_Z,
    SPEED_OF_LIGHT_KMS,
    CatalogError,
    col,
    is_float,
    missing,
    number_from_text,
    ordered_unique,
    require_columns,
    spark_type,
    type_of,
    valid_z,
    z_range,
)

Spec = dict[str, Any]


def _text(spec: Spec, key: str, default: str | None = None) -> str:
    value = spec.get(key, default)
    if not isinstance(value, str) or not value.strip():
        raise CatalogError(f"{spec.get('type')} requires {key} to be a non-empty string.")
    return value


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def cast_column(df: DataFrame, spec: Spec) -> DataFrame:
    name = _text(spec, "column")
    return df.withColumn(name, col(name).cast(spark_type(_text(spec, "dtype"))))


def add_constant(df: DataFrame, spec: Spec) -> DataFrame:
    value = spec.get("value")
    literal = F.lit(None).cast("string") if value is None else F.lit(value)
    if isinstance(value, int) and not isinstance(value, bool):
        literal = F.lit(value).cast("bigint")
    return df.withColumn(_text(spec, "name"), literal)


def absolute_value(df: DataFrame, spec: Spec) -> DataFrame:
    value = F.abs(col(_text(spec, "input_column")))
    if spec.get("dtype") is not None:
        value = value.cast(spark_type(_text(spec, "dtype")))
    return df.withColumn(_text(spec, "output_column"), value)


def signed_value_sign(df: DataFrame, spec: Spec) -> DataFrame:
    negative, other = spec.get("negative_label", "-"), spec.get("non_negative_label", "+")
    if not isinstance(negative, str) or not isinstance(other, str):
        raise CatalogError("signed_value_sign: a label is no text.")
    # A missing value is not below zero, so it takes the non-negative label.
    sign = F.when(col(_text(spec, "input_column")) < 0, F.lit(negative)).otherwise(F.lit(other))
    return df.withColumn(_text(spec, "output_column"), sign)


def replace_values(df: DataFrame, spec: Spec) -> DataFrame:
    """All replacements look at the original value; a ``from`` of a foreign type never matches."""
    name, pairs = _text(spec, "column"), spec.get("replacements")
    if not isinstance(pairs, (list, tuple)):
        raise CatalogError("replace_values: replacements are given as a list of from and to.")
    mapping = {p["from"]: p["to"] for p in pairs}
    dtype, source = type_of(df, name), col(name)

    def comparable(value: Any) -> bool:
        if isinstance(dtype, T.StringType):
            return isinstance(value, str)
        if isinstance(dtype, T.BooleanType):
            return isinstance(value, bool)
        return isinstance(dtype, T.NumericType) and _is_number(value)

    def absent(value: Any) -> bool:
        return value is None or (isinstance(value, float) and math.isnan(value))

    active = {k: v for k, v in mapping.items() if absent(k) or comparable(k)}
    if not active:
        return df
    targets = [v for v in active.values() if not absent(v)]
    result = dtype
    if not all(comparable(v) for v in targets):
        result = T.StringType()
    elif isinstance(dtype, T.IntegralType) and any(float(v) != int(v) for v in targets):
        result = T.DoubleType()
    branches = None
    for old, new in active.items():
        hit = missing(source, dtype) if absent(old) else (source == F.lit(old))
        value = F.lit(None if absent(new) else new).cast(result)
        branches = F.when(hit, value) if branches is None else branches.when(hit, value)
    return df.withColumn(name, branches.otherwise(source.cast(result)))


def ra_hms_to_degrees(df: DataFrame, spec: Spec) -> DataFrame:
    h, m, s = (col(_text(spec, k)).cast("double") for k in ("hours", "minutes", "seconds"))
    return df.withColumn(_text(spec, "output_column"), F.lit(15.0) * (h + m / F.lit(60.0) + s / F.lit(3600.0)))


def dec_dms_to_degrees(df: DataFrame, spec: Spec) -> DataFrame:
    """Sign of the degrees times the magnitude; ``0 deg`` has sign 0, so such rows become 0."""
    d, m, s = (col(_text(spec, k)).cast("double") for k in ("degrees", "arcminutes", "arcseconds"))
    value = F.signum(d) * (F.abs(d) + m / F.lit(60.0) + s / F.lit(3600.0))
    return df.withColumn(_text(spec, "output_column"), value)


def zero_degree_rows(df: DataFrame, spec: Spec) -> DataFrame:
    """How many rows ``dec_dms_to_degrees`` flattens to 0 although they have arcminutes or -seconds."""
    d, m, s = (col(_text(spec, k)).cast("double") for k in ("degrees", "arcminutes", "arcseconds"))
    return df.agg(F.count_if((d == 0) & ((m != 0) | (s != 0))).alias("zero_degree_rows"))


def velocity_to_redshift(df: DataFrame, spec: Spec) -> DataFrame:
    c = F.lit(SPEED_OF_LIGHT_KMS)
    velocity = _text(spec, "velocity_column")
    df = df.withColumn(_text(spec, "output_column", "redshift"), col(velocity).cast("double") / c)
    if spec.get("velocity_error_column") is not None:
        error = _text(spec, "velocity_error_column")
        df = df.withColumn(_text(spec, "error_output_column", "redshift_err"), col(error).cast("double") / c)
    return df


def coalesce_redshift(df: DataFrame, spec: Spec) -> DataFrame:
    """First valid candidate wins; a valid candidate equal to ``invalid_value`` counts as unset."""
    output, names = _text(spec, "output_column"), spec.get("columns")
    if not isinstance(names, (list, tuple)) or not names or not all(isinstance(n, str) for n in names):
        raise CatalogError("coalesce_redshift: columns names at least one candidate.")
    invalid = spec.get("invalid_value", INVALID_Z)
    if not _is_number(invalid) or math.isnan(invalid):
        raise CatalogError("coalesce_redshift: invalid_value is no number.")
    blueshifts = spec.get("allow_blueshifts", True)
    if not isinstance(blueshifts, bool):
        raise CatalogError("coalesce_redshift: allow_blueshifts is a truth value.")
    labels = spec.get("labels")
    if labels is not None and (
        not isinstance(labels, (list, tuple))
        or len(labels) != len(names)
        or not all(isinstance(label, str) and label.strip() for label in labels)
    ):
        raise CatalogError("coalesce_redshift: every candidate takes one label, and none may be blank.")
    labels = list(labels) if labels is not None else list(names)

    sentinel = F.lit(float(invalid))
    candidates = [col(n).cast("double") for n in names]
    low, high = z_range(blueshifts)
    usable = [valid_z(c, blueshifts) for c in candidates]
    if low < invalid < high:
        usable = [u & (c != sentinel) for u, c in zip(usable, candidates)]
    value = F.coalesce(*[F.when(u, c) for u, c in zip(usable, candidates)], sentinel)
    if {type_of(df, n).simpleString() for n in names} == {"float"}:
        value = value.cast("float")
    new = {output: value}
    if spec.get("label_column") is not None:
        no_label = F.lit(_text(spec, "invalid_label", "invalid"))
        picks = [F.when(u, F.lit(label)) for u, label in zip(usable, labels)]
        if low < invalid < high:  # with nothing usable the last candidate still names the row if valid
            picks.append(F.when(valid_z(candidates[-1], blueshifts), F.lit(labels[-1])))
        new[_text(spec, "label_column")] = F.coalesce(*picks, no_label)
    return df.withColumns(new)


# Degrees per unit of a coordinate column.
_UNIT_DEGREES = {"hourangle": 15.0, "deg": 1.0, "degree": 1.0, "rad": 180.0 / math.pi, "radian": 180.0 / math.pi}
_SEXAGESIMAL = r"^[+-]?\d+(\.\d*)?\s*[hd°:\s]\s*(\d+(\.\d*)?\s*([m'′:\s]\s*(\d+(\.\d*)?\s*[s\"″]?)?)?)?$"


def _angle_columns(df: DataFrame, name: str, key: str) -> dict[str, Column]:
    """Pieces of a text angle, as columns of their own so that each pattern runs once per row."""
    if not isinstance(type_of(df, name), T.StringType):
        return {}
    text = F.trim(col(name))
    return {
        f"__{key}_number": number_from_text(text),
        f"__{key}_parts": F.regexp_extract_all(text, F.lit(r"(\d+\.?\d*)"), F.lit(1)).cast("array<double>"),
        f"__{key}_shape": text.rlike(_SEXAGESIMAL),
        f"__{key}_unit": F.lower(F.regexp_extract(text, r"^[+-]?[0-9.]+\s*([hd°])", 1)),
    }


def _angle_degrees(df: DataFrame, name: str, key: str, unit: str, label: str) -> Column:
    """Numbers in ``unit``, or text: a number, or sexagesimal parts with any usual separators."""
    if unit not in _UNIT_DEGREES:
        raise CatalogError(f"Unsupported coordinate unit: {unit!r}.")
    scale, dtype = F.lit(_UNIT_DEGREES[unit]), type_of(df, name)
    if isinstance(dtype, T.NumericType):
        return col(name).cast("double") * scale
    if not isinstance(dtype, T.StringType):
        raise CatalogError(f"{label} column '{name}' must be numeric or text.")
    number, parts = F.col(f"__{key}_number"), F.col(f"__{key}_parts")

    def part(i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(0.0))

    size = part(0) + part(1) / F.lit(60.0) + part(2) / F.lit(3600.0)
    # The sign belongs to the whole text, so -00:30 keeps it.
    signed = F.when(F.trim(col(name)).startswith("-"), -size).otherwise(size)
    own = F.col(f"__{key}_unit")
    own_scale = F.when(own == "h", F.lit(15.0)).when(own != "", F.lit(1.0)).otherwise(scale)
    bad = ~F.col(f"__{key}_shape") | (part(1) > 60) | (part(2) > 60) | ((own_scale == 15.0) & (part(0) > 24))
    message = F.concat(F.lit(f"{label} value cannot be read as an angle: "), col(name))
    return (
        F.when(number.isNotNull(), number * scale)
        .when(bad, F.raise_error(message).cast("double"))
        .when(col(name).isNotNull(), signed * own_scale)
    )


def skycoord_to_degrees(df: DataFrame, spec: Spec) -> DataFrame:
    """RA wrapped to [0, 360); a Dec beyond +-90 is an error."""
    ra_name, dec_name = _text(spec, "ra_column"), _text(spec, "dec_column")
    ra_unit, dec_unit = _text(spec, "ra_unit", "hourangle"), _text(spec, "dec_unit", "deg")
    pieces = _angle_columns(df, ra_name, "ra") | _angle_columns(df, dec_name, "dec")
    split = df.withColumns(pieces)
    split = split.withColumns(
        {
            "__ra": F.pmod(_angle_degrees(df, ra_name, "ra", ra_unit, "RA"), F.lit(360.0)),
            "__dec": _angle_degrees(df, dec_name, "dec", dec_unit, "Dec"),
        }
    )
    # pmod of a tiny negative rounds up to the divisor itself.
    ra = F.when(F.col("__ra") >= 360.0, F.lit(0.0)).otherwise(F.col("__ra"))
    dec = F.col("__dec")
    message = F.concat(F.lit("Dec is outside [-90, 90] degrees: "), dec.cast("string"))
    out_of_range = (F.abs(dec) > 90.0) & ~F.isnan(dec)
    dec = F.when(out_of_range, F.raise_error(message).cast("double")).otherwise(dec)
    new = {_text(spec, "output_ra_column"): ra, _text(spec, "output_dec_column"): dec}
    return split.withColumns(new).drop("__ra", "__dec", *pieces)


class _Kind:
    """One transformation: how to apply it, which columns it reads and which it generates."""

    def __init__(self, apply: Callable[[DataFrame, Spec], DataFrame], reads: Sequence[str], makes: Sequence[str]):
        self.apply, self.reads, self.makes = apply, reads, makes


TRANSFORMATIONS: dict[str, _Kind] = {
    "cast": _Kind(cast_column, ["column"], []),
    "add_constant_column": _Kind(add_constant, [], ["name"]),
    "absolute_value": _Kind(absolute_value, ["input_column"], ["output_column"]),
    "signed_value_sign": _Kind(signed_value_sign, ["input_column"], ["output_column"]),
    "replace_values": _Kind(replace_values, ["column"], []),
    "ra_hms_to_degrees": _Kind(ra_hms_to_degrees, ["hours", "minutes", "seconds"], ["output_column"]),
    "dec_dms_to_degrees": _Kind(dec_dms_to_degrees, ["degrees", "arcminutes", "arcseconds"], ["output_column"]),
    "velocity_to_redshift": _Kind(
        velocity_to_redshift, ["velocity_column", "velocity_error_column"], ["output_column", "error_output_column"]
    ),
    "coalesce_redshift": _Kind(coalesce_redshift, ["columns"], ["output_column", "label_column"]),
    "skycoord_to_degrees": _Kind(
        skycoord_to_degrees, ["ra_column", "dec_column"], ["output_ra_column", "output_dec_column"]
    ),
}


def _kind(spec: Spec) -> _Kind:
    if not isinstance(spec, dict) or not isinstance(spec.get("type"), str):
        raise CatalogError("A transformation is a mapping whose type names what it does.")
    if spec["type"] not in TRANSFORMATIONS:
        raise CatalogError(f"Unsupported transformation type: {spec['type']}.")
    return TRANSFORMATIONS[spec["type"]]


def input_columns(spec: Spec) -> list[str]:
    """Columns a transformation reads."""
    found: list[str] = []
    for key in _kind(spec).reads:
        value = spec.get(key)
        found += [value] if isinstance(value, str) else list(value or [])
    return found


def generated_columns(spec: Spec) -> list[str]:
    """Columns a transformation adds, including the defaults of the velocity conversion."""
    makes = _kind(spec).makes
    if spec.get("type") == "velocity_to_redshift":
        spec = {"output_column": "redshift", **spec}
        if spec.get("velocity_error_column") is not None:
            spec = {"error_output_column": "redshift_err", **spec}
        else:
            spec = {k: v for k, v in spec.items() if k != "error_output_column"}
    return [spec[key] for key in makes if isinstance(spec.get(key), str)]


def apply_transformations(
    df: DataFrame, transformations: Sequence[Spec], allow_blueshifts: bool = True
) -> tuple[DataFrame, list[str]]:
    """Apply the specs in order; returns the frame and the generated columns, first-seen order."""

    def step(frame: DataFrame, spec: Spec) -> DataFrame:
        kind = _kind(spec)
        require_columns(frame, input_columns(spec), spec["type"])
        if spec["type"] == "coalesce_redshift":
            spec = {"allow_blueshifts": allow_blueshifts, **spec}
        return kind.apply(frame, spec)

    made = [name for spec in transformations for name in generated_columns(spec)]
    return reduce(step, transformations, df), ordered_unique(made)

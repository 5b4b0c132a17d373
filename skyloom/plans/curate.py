"""The curation job: transform, validate, apply the redshift policy, filter, project."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from skyloom.functions.expr import (
    INVALID_Z,
    SPEED_OF_LIGHT_KMS,
    CatalogError,
    col,
    is_numeric,
    ordered_unique,
    require_columns,
    type_of,
    z_range,
)
from skyloom.functions.healpix import INDEX_COLUMN
from skyloom.operators.tiles import TileMap
from skyloom.operators.transforms import apply_transformations, generated_columns
from skyloom.operators.validate import (
    check_ranges,
    filter_redshift,
    final_columns,
    flag_redshift,
    observed,
    range_metrics,
    redshift_interval,
    required_inputs,
    standard_ranges,
)
from skyloom.sinks.collection import write_collection
from skyloom.sinks.parquet import check_output, file_count, output_layout, write_manifest, write_parquet


@dataclass
class CurateSpec:
    """Checked form of a curation mapping (keys as in ``from_dict``)."""

    ra: str
    dec: str
    z: str
    selection: list[str] = field(default_factory=list)
    transformations: list[dict[str, Any]] = field(default_factory=list)
    invalid_policy: str = "fail"
    invalid_value: float = INVALID_Z
    allow_blueshifts: bool = True
    filters: list[tuple[str, float]] = field(default_factory=list)
    generated_position: str = "last"

    @property
    def standard(self) -> list[str]:
        return [self.ra, self.dec, self.z]

    @classmethod
    def from_dict(cls, spec: dict[str, Any]) -> CurateSpec:
        """Read a mapping by the table of its keys below; every fault names its key."""
        sections = {name: _section(spec, *names) for name, names in _SECTIONS.items()}
        read = {f: _entry(sections[s], s, key, kind, default) for f, (s, key, kind, default) in _ENTRIES.items()}
        keep = spec.get("column_selection")
        keep = keep.get("keep_columns") if isinstance(keep, dict) else keep
        if keep is not None and not (isinstance(keep, (list, tuple)) and all(isinstance(n, str) for n in keep)):
            raise CatalogError("column_selection: column names were expected, as a list or under keep_columns.")
        if read["invalid_policy"].lower() not in POLICIES:
            raise CatalogError(f"redshift.invalid_policy: {read['invalid_policy']!r} is none of {', '.join(POLICIES)}.")
        if not all(isinstance(f, dict) for f in read["filters"]):
            raise CatalogError("redshift.filters: each filter is a mapping with op and value.")
        return cls(
            **read
            | {
                "selection": ordered_unique(n.strip() for n in keep or () if n.strip()),
                "invalid_policy": read["invalid_policy"].lower(),
                "invalid_value": float(read["invalid_value"]),
                "filters": [(f.get("op", f.get("operator")), f.get("value")) for f in read["filters"]],
                "generated_position": read["generated_position"].lower(),
            }
        )


POLICIES = ("fail", "flag", "keep")
_KINDS = {"text": str, "number": (int, float), "flag": bool, "list": (list, tuple)}
# Section -> its keys in a mapping; "" is the mapping itself.
_SECTIONS = {"": (), "coordinates": ("coordinates", "coordinate_validation"), "redshift": ("redshift", "redshift_validation")}
# Field of a spec -> section, key, kind of value, default (None: the key is required).
_ENTRIES: dict[str, tuple[str, str, str, Any]] = {
    "ra": ("coordinates", "ra_column", "text", None),
    "dec": ("coordinates", "dec_column", "text", None),
    "z": ("redshift", "column", "text", None),
    "transformations": ("", "transformations", "list", []),
    "invalid_policy": ("redshift", "invalid_policy", "text", "fail"),
    "invalid_value": ("redshift", "invalid_value", "number", INVALID_Z),
    "allow_blueshifts": ("redshift", "allow_blueshifts", "flag", True),
    "filters": ("redshift", "filters", "list", []),
    "generated_position": ("", "generated_columns_position", "text", "last"),
}


def _section(spec: dict[str, Any], *names: str) -> dict[str, Any]:
    if not names:
        return spec
    found = next((spec[n] for n in names if spec.get(n) is not None), {})
    if not isinstance(found, dict):
        raise CatalogError(f"{names[0]}: a mapping was expected.")
    return found


def _entry(section: dict[str, Any], name: str, key: str, kind: str, default: Any) -> Any:
    value, label = section.get(key), f"{name}.{key}".lstrip(".")
    if value is None or (kind == "list" and not value):
        if default is None:
            raise CatalogError(f"{label} is missing.")
        return type(default)(default)
    if not isinstance(value, _KINDS[kind]) or (kind == "number" and isinstance(value, bool)) or value == "":
        raise CatalogError(f"{label}: {value!r} is no {kind}.")
    return list(value) if kind == "list" else value


def _transformed(df: DataFrame, spec: CurateSpec) -> tuple[DataFrame, list[str]]:
    needed = required_inputs(spec.selection, spec.transformations, spec.standard)
    if needed is not None:
        require_columns(df, needed, "curation input")
    df, generated = apply_transformations(df, spec.transformations, spec.allow_blueshifts)
    require_columns(df, spec.standard, "validation")
    return df, generated


def _finished(df: DataFrame, spec: CurateSpec, generated: list[str]) -> DataFrame:
    names = final_columns(df.columns, spec.selection, generated, spec.standard, spec.generated_position)
    low, high = z_range(spec.allow_blueshifts)
    if spec.invalid_policy == "flag" and (not spec.filters or low < spec.invalid_value < high):
        # A filter keeps valid redshifts only, so unless the flag itself is valid there is nothing to flag.
        df = flag_redshift(df, spec.z, spec.invalid_value, spec.allow_blueshifts)
    elif spec.filters:
        df = _velocity_filter(df, spec)
    return filter_redshift(df, spec.z, spec.filters, spec.allow_blueshifts).select(*[col(n) for n in names])


def _velocity_filter(df: DataFrame, spec: CurateSpec) -> DataFrame:
    """Repeat the redshift filter on the velocity the redshift comes from.

    A scan cannot use a condition on ``v / c``, but it can skip row groups by one
    on ``v``. The bounds are a little wide; the filter itself stays.
    """

    def writes(step: dict[str, Any]) -> list[str]:
        changed = [step["column"]] if step["type"] in ("cast", "replace_values") else []
        return changed + generated_columns(step)

    makers = [t for t in spec.transformations if spec.z in writes(t)]
    if len(makers) != 1 or makers[0]["type"] != "velocity_to_redshift":
        return df
    maker = makers[0]
    velocity = maker["velocity_column"]
    if maker.get("output_column", "redshift") != spec.z or any(velocity in writes(t) for t in spec.transformations):
        return df
    if not is_numeric(type_of(df, velocity)):
        return df
    kept = redshift_interval(spec.filters, spec.allow_blueshifts)
    low, high = (z * SPEED_OF_LIGHT_KMS for z in (kept.low, kept.high))
    low, high = low - abs(low) * 1e-9, high + abs(high) * 1e-9
    return df.where((col(velocity) >= F.lit(low)) & (col(velocity) <= F.lit(high)))


def curate(df: DataFrame, spec: dict[str, Any] | CurateSpec, validate: bool = True) -> DataFrame:
    """Curated catalog as a lazy frame.

    ``validate`` runs one aggregate over the three standard columns first and
    raises on a broken range; the result itself stays a narrow map over the scan.
    A write that should read its input only once uses ``skyloom.curate_to``.
    """
    spec = spec if isinstance(spec, CurateSpec) else CurateSpec.from_dict(spec)
    frame, generated = _transformed(df, spec)
    if validate:
        row = standard_ranges(frame, *spec.standard, spec.allow_blueshifts).first().asDict()
        check_ranges(row, *spec.standard, spec.invalid_policy, spec.allow_blueshifts)
    return _finished(frame, spec, generated)


def _curate_observed(df: DataFrame, spec: CurateSpec) -> tuple[DataFrame, Callable[[], None]]:
    """Curated catalog, and the check of its ranges to call once an action has read the input."""
    frame, generated = _transformed(df, spec)
    frame, ranges = observed(frame, range_metrics(frame, *spec.standard, spec.allow_blueshifts))

    def verify() -> None:
        check_ranges(ranges(), *spec.standard, spec.invalid_policy, spec.allow_blueshifts)

    return _finished(frame, spec, generated), verify


def curate_to(
    df: DataFrame,
    spec: dict[str, Any] | CurateSpec,
    path: str,
    output_mode: str = "partitioned",
    overwrite: bool = False,
    sources: list[str] | None = None,
    target_partition_bytes: int | None = None,
) -> list[str]:
    """Curate into a Parquet dataset, reading the input once; returns the output columns.

    ``target_partition_bytes`` evens out what is written, for filters that keep little.
    Validation rides on the write. The output takes its place only if it passes; until
    then whatever was there stays, so an input may be replaced by its own curated form.
    """
    spark = df.sparkSession
    checked = spec if isinstance(spec, CurateSpec) else CurateSpec.from_dict(spec)
    result, verify = _curate_observed(df, checked)

    def finish(staged: str) -> None:
        verify()
        facts = _facts(checked, result, sources, output_layout(output_mode), "parquet")
        facts["n_partitions"] = file_count(spark, staged)
        write_manifest(spark, staged, facts)

    write_parquet(result, path, output_mode, overwrite, target_partition_bytes, sources, finish)
    return result.columns


def curate_to_collection(
    df: DataFrame,
    spec: dict[str, Any] | CurateSpec,
    path: str,
    ra: str | None = None,
    dec: str | None = None,
    overwrite: bool = False,
    sources: list[str] | None = None,
    **options: Any,
) -> TileMap:
    """Curate into a spatial collection; ``options`` go to ``write_collection``.

    The input may itself come from ``read_spatial``: rows are placed in tiles
    again and the margin is always made anew, as transformations may move both.
    Validation rides on the scan that sizes the tiles.
    """
    checked = spec if isinstance(spec, CurateSpec) else CurateSpec.from_dict(spec)
    result, verify = _curate_observed(df.drop(INDEX_COLUMN), checked)
    ra, dec = ra or checked.ra, dec or checked.dec
    require_columns(result, [ra, dec], "spatial output")
    facts = _facts(checked, result, sources, "spatial", "hats")
    check_output(df.sparkSession, path, overwrite, sources)
    return write_collection(result, path, ra, dec, overwrite=overwrite, verify=verify, facts=facts, **options)


def _facts(spec: CurateSpec, result: DataFrame, sources: list[str] | None, mode: str, kind: str) -> dict[str, Any]:
    return {
        "source_paths": sources or [],
        "partition_format": kind,
        "output_mode": mode,
        "columns": result.columns,
        "coordinates": {"ra_column": spec.ra, "dec_column": spec.dec},
        "redshift": {
            "column": spec.z,
            "invalid_policy": spec.invalid_policy,
            "invalid_value": spec.invalid_value,
            "allow_blueshifts": spec.allow_blueshifts,
            "filters": spec.filters,
        },
        "transformations": spec.transformations,
    }

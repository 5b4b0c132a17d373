"""One Spark query per operator, by name."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import skyloom
from checks import fits_files
from checks.views import view
from skyloom.functions.expr import col
from skyloom.functions.healpix import INDEX_COLUMN, add_sky_index
from skyloom.operators import footprint, profile, quality, tiles, transforms, union, validate
from skyloom.plans.curate import CurateSpec, curate, curate_to, curate_to_collection
from skyloom.session import as_table, scratch_path

cloudpickle.register_pickle_by_value(fits_files)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Tile sizes of the registered queries; small, so that every order occurs.
TILE_ROWS, TILE_ORDER = 80, 6

PIPELINE = {
    "column_selection": ["object_id", "ra", "dec", "z_final", "quality"],
    "transformations": [
        {"type": "velocity_to_redshift", "velocity_column": "v_kms", "output_column": "z_vel"},
        {
            "type": "coalesce_redshift",
            "output_column": "z_final",
            "columns": ["z_spec", "z_phot", "z_vel"],
            "label_column": "z_source",
            "labels": ["s", "p", "v"],
            "invalid_label": "none",
        },
        {"type": "add_constant_column", "name": "survey", "value": "SAMPLE"},
    ],
    "coordinates": {"ra_column": "ra", "dec_column": "dec"},
    "redshift": {
        "column": "z_final",
        "invalid_policy": "flag",
        "allow_blueshifts": False,
        "filters": [{"op": ">", "value": 0.05}, {"op": "<=", "value": 4}],
    },
}

FLAGGED = {
    "transformations": [],
    "coordinates": {"ra_column": "ra", "dec_column": "dec"},
    "redshift": {"column": "z_spec", "invalid_policy": "flag"},
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _transformed(spark: SparkSession, sf_dir: str, name: str, *specs: dict) -> DataFrame:
    return transforms.apply_transformations(view(spark, sf_dir, name), list(specs))[0]


# --- sources ------------------------------------------------------------------------------


@query
def scan_csv(spark, sf_dir):
    folder = scratch_path(spark, "csv")
    view(spark, sf_dir, "catalog").write.option("header", True).csv(folder)
    return skyloom.read_csv(spark, folder)


@query
def scan_whitespace(spark, sf_dir):
    df = view(spark, sf_dir, "catalog")
    folder = scratch_path(spark, "whitespace")
    names = ["object_id", "ra", "dec", "z_spec", "object_type"]
    words = [F.coalesce(F.replace(col(n).cast("string"), F.lit(" "), F.lit("_")), F.lit("NaN")) for n in names]
    comment = F.when(F.col("object_id") % 3 == 0, F.lit("   # checked")).otherwise(F.lit(""))
    df.select(F.concat(F.concat_ws("  ", *words), comment)).write.text(folder)
    return skyloom.read_whitespace(spark, folder, names)


@query
def scan_parquet(spark, sf_dir):
    names = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    return skyloom.read_parquet(spark, f"{sf_dir}/lineitem.parquet", names)


@query
def scan_fits(spark, sf_dir):
    folder = scratch_path(spark, "fits").removeprefix("file:")
    os.makedirs(folder)
    view(spark, sf_dir, "catalog").drop("z_phot", "v_kms").mapInPandas(
        fits_files.catalog_writer(folder), "path string, n long"
    ).count()
    return skyloom.read_fits(spark, folder)


def _collection(spark: SparkSession, df: DataFrame, margin: float | None) -> str:
    path = scratch_path(spark, "sky")
    skyloom.write_collection(df, path, "ra", "dec", name="main", margin_arcsec=margin, max_tile_rows=2000)
    return path


@query
def scan_spatial(spark, sf_dir):
    path = _collection(spark, view(spark, sf_dir, "catalog"), None)
    return skyloom.read_spatial(spark, path, ["object_id", "ra", "dec", "z_spec", "quality"])


@query
def scan_spatial_margin(spark, sf_dir):
    path = _collection(spark, view(spark, sf_dir, "catalog"), 1800.0)
    return skyloom.read_margin(spark, path, columns=["object_id", "ra", "dec"], tiles=True)


@query
def scan_footprint(spark, sf_dir):
    folder = scratch_path(spark, "footprint")
    view(spark, sf_dir, "vertices").write.option("header", True).csv(folder)
    return skyloom.read_footprint(spark, folder, "region_vertices").select(
        F.col("region_id").cast("bigint").alias("region_id"), "ring_type", "vertex_id", "ra_deg", "dec_deg"
    )


# --- union --------------------------------------------------------------------------------


@query
def union_strict(spark, sf_dir):
    df = view(spark, sf_dir, "catalog")
    return union.union_strict([df.where(F.col("quality") == q) for q in ("F", "O", "P")])


@query
def union_outer(spark, sf_dir):
    df = view(spark, sf_dir, "catalog")
    final, open_, partial = (df.where(F.col("quality") == q) for q in ("F", "O", "P"))
    partial = partial.withColumn("v_kms", F.floor("v_kms")).withColumn("extra", F.col("object_id") * 2)
    return union.union_outer([final, open_.drop("z_phot"), partial])


# --- transformations ----------------------------------------------------------------------


@query
def t_cast(spark, sf_dir):
    return _transformed(
        spark,
        sf_dir,
        "catalog",
        {"type": "cast", "column": "v_kms", "dtype": "int64"},
        {"type": "cast", "column": "object_id", "dtype": "str"},
    ).select("object_id", "v_kms")


@query
def t_constant(spark, sf_dir):
    return _transformed(
        spark,
        sf_dir,
        "catalog",
        {"type": "add_constant_column", "name": "survey", "value": "SAMPLE"},
        {"type": "add_constant_column", "name": "release", "value": 2},
        {"type": "add_constant_column", "name": "public", "value": True},
        {"type": "add_constant_column", "name": "remark", "value": None},
    ).select("object_id", "survey", "release", "public", "remark")


@query
def t_abs(spark, sf_dir):
    spec = {"type": "absolute_value", "input_column": "dec_d", "output_column": "dec_abs", "dtype": "int64"}
    return _transformed(spark, sf_dir, "sexagesimal", spec).select("object_id", "dec_abs")


@query
def t_sign(spark, sf_dir):
    spec = {"type": "signed_value_sign", "input_column": "z_spec", "output_column": "sign", "negative_label": "neg"}
    return _transformed(spark, sf_dir, "catalog", spec).select("object_id", "sign")


@query
def t_replace(spark, sf_dir):
    words = [
        {"from": "F", "to": "O"},
        {"from": "O", "to": "open"},
        {"from": "P", "to": None},
        {"from": 1, "to": "no match"},
    ]
    numbers = [{"from": -1, "to": None}, {"from": "-1", "to": 5}]
    return _transformed(
        spark,
        sf_dir,
        "catalog",
        {"type": "replace_values", "column": "quality", "replacements": words},
        {"type": "replace_values", "column": "z_phot", "replacements": numbers},
        {"type": "replace_values", "column": "z_spec", "replacements": [{"from": None, "to": -9}]},
    ).select("object_id", "quality", "z_phot", "z_spec")


_RA_HMS = {"type": "ra_hms_to_degrees", "output_column": "ra", "hours": "ra_h", "minutes": "ra_m", "seconds": "ra_s"}
_DEC_DMS = {
    "type": "dec_dms_to_degrees",
    "output_column": "dec",
    "degrees": "dec_d",
    "arcminutes": "dec_m",
    "arcseconds": "dec_s",
}


@query
def t_ra_hms(spark, sf_dir):
    return _transformed(spark, sf_dir, "sexagesimal", _RA_HMS).select("object_id", "ra")


@query
def t_dec_dms(spark, sf_dir):
    return _transformed(spark, sf_dir, "sexagesimal", _DEC_DMS).select("object_id", "dec")


@query
def t_dec_dms_zero_rows(spark, sf_dir):
    return transforms.zero_degree_rows(view(spark, sf_dir, "sexagesimal"), _DEC_DMS)


@query
def t_velocity(spark, sf_dir):
    spec = {"type": "velocity_to_redshift", "velocity_column": "v_kms", "velocity_error_column": "z_phot"}
    return _transformed(spark, sf_dir, "catalog", spec).select("object_id", "redshift", "redshift_err")


_COALESCE = {"type": "coalesce_redshift", "output_column": "z_final", "columns": ["z_spec", "z_phot"]}


@query
def t_coalesce_z(spark, sf_dir):
    return _transformed(spark, sf_dir, "catalog", _COALESCE).select("object_id", "z_final")


@query
def t_coalesce_z_label(spark, sf_dir):
    spec = {**_COALESCE, "label_column": "z_source", "labels": ["s", "p"], "invalid_label": "none"}
    return _transformed(spark, sf_dir, "catalog", spec).select("object_id", "z_final", "z_source")


@query
def t_skycoord(spark, sf_dir):
    spec = {
        "type": "skycoord_to_degrees",
        "ra_column": "ra_text",
        "dec_column": "dec_text",
        "output_ra_column": "ra",
        "output_dec_column": "dec",
    }
    return _transformed(spark, sf_dir, "sexagesimal", spec).select("object_id", "ra", "dec")


@query
def t_skycoord_numbers(spark, sf_dir):
    df = view(spark, sf_dir, "catalog").select(
        "object_id", (F.col("ra") / 15.0 - 12.0).alias("ra_hours"), F.radians("dec").alias("dec_rad")
    )
    spec = {
        "type": "skycoord_to_degrees",
        "ra_column": "ra_hours",
        "dec_column": "dec_rad",
        "output_ra_column": "ra",
        "output_dec_column": "dec",
        "dec_unit": "rad",
    }
    out = transforms.apply_transformations(df, [spec])[0]
    return out.select("object_id", "ra", F.round("dec", 9).alias("dec"))


@query
def t_pipeline(spark, sf_dir):
    sign = {"type": "signed_value_sign", "input_column": "dec_d", "output_column": "dec_sign"}
    magnitude = {"type": "absolute_value", "input_column": "dec", "output_column": "dec_abs"}
    df = _transformed(spark, sf_dir, "sexagesimal", _RA_HMS, sign, _DEC_DMS, magnitude)
    return df.select("object_id", "ra", "dec_sign", "dec", "dec_abs")


# --- projection, validation, policies -----------------------------------------------------


@query
def project_required(spark, sf_dir):
    df = view(spark, sf_dir, "catalog")
    spec = CurateSpec.from_dict(PIPELINE)
    needed = validate.required_inputs(spec.selection, spec.transformations, spec.standard)
    return df.select(*[col(n) for n in needed])


def _placed(spark, sf_dir, position: str, selection: list[str]) -> DataFrame:
    spec = {
        **FLAGGED,
        "column_selection": selection,
        "transformations": [{"type": "add_constant_column", "name": "survey", "value": "SAMPLE"}],
        "generated_columns_position": position,
    }
    return curate(view(spark, sf_dir, "catalog"), spec)


@query
def project_final_first(spark, sf_dir):
    return _placed(spark, sf_dir, "first", ["dec", "ra", "z_spec", "object_id"])


@query
def project_final_last(spark, sf_dir):
    return _placed(spark, sf_dir, "last", [])


@query
def standard_ranges(spark, sf_dir):
    return validate.standard_ranges(view(spark, sf_dir, "catalog"), "ra", "dec", "z_spec")


@query
def coord_violations(spark, sf_dir):
    return validate.coordinate_violations(view(spark, sf_dir, "gaps"), "ra", "dec").select("object_id", "ra", "dec")


@query
def z_violations(spark, sf_dir):
    df = validate.redshift_violations(view(spark, sf_dir, "catalog"), "z_spec", allow_blueshifts=False)
    return df.select("object_id", "z_spec")


@query
def z_flag(spark, sf_dir):
    return validate.flag_redshift(view(spark, sf_dir, "catalog"), "z_spec").select("object_id", "z_spec")


@query
def z_flag_no_blueshift(spark, sf_dir):
    df = validate.flag_redshift(view(spark, sf_dir, "catalog"), "z_spec", -9.0, allow_blueshifts=False)
    return df.select("object_id", "z_spec")


@query
def z_keep(spark, sf_dir):
    spec = {**FLAGGED, "redshift": {"column": "z_spec", "invalid_policy": "keep"}}
    return curate(view(spark, sf_dir, "catalog"), spec).select("object_id", "z_spec")


@query
def z_filter_range(spark, sf_dir):
    df = validate.filter_redshift(view(spark, sf_dir, "catalog"), "z_spec", [(">", 1.6), ("<", 9)])
    return df.select("object_id", "z_spec")


@query
def z_filter_ops(spark, sf_dir):
    df = view(spark, sf_dir, "gaps").withColumn("z_nan", F.round("z_nan", 1))
    return validate.filter_redshift(df, "z_nan", [(">=", 0.5), ("<=", 3), ("!=", 1.5)]).select("object_id", "z_nan")


@query
def spatial_coord_check(spark, sf_dir):
    return validate.spatial_coordinate_ranges(view(spark, sf_dir, "gaps"), "ra", "z_nan")


# --- profiling ----------------------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    """Sums depend on the order of addition in the last digits; compare to six decimals."""
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query
def numeric_stats(spark, sf_dir):
    return _rounded(profile.numeric_stats(view(spark, sf_dir, "gaps"), ["ra", "z_nan", "nothing", "v_kms"]))


@query
def numeric_stats_by_group_merged(spark, sf_dir):
    """Statistics of many parts merged: the engine's own partial and final aggregate does it."""
    df = view(spark, sf_dir, "catalog").repartition("quality", "object_type")
    return _rounded(profile.numeric_stats(df, ["ra", "z_spec", "v_kms"]))


@query
def categorical_uniques(spark, sf_dir):
    return profile.categorical_uniques(view(spark, sf_dir, "gaps"), ["flag", "note"], 10)


@query
def candidate_columns(spark, sf_dir):
    """Column names of many catalogs: a stem joined to every distinct word of the documents."""
    words = (
        spark.read.parquet(f"{sf_dir}/documents.parquet")
        .select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word"))
        .where(F.col("word") != "")
        .distinct()
    )
    stems = F.array(*[F.lit(s) for s in NAME_STEMS])
    stem = F.get(stems, (F.length("word") % len(NAME_STEMS)).cast("int"))
    return profile.classify_names(words.select(F.concat(stem, F.col("word")).alias("name")))


NAME_STEMS = ["", "RA_DEG_", "best_z_", "ZWARN", "err_z_", "x_objectid_", "eta_type_", "target_ra"]


@query
def sample_head(spark, sf_dir):
    return profile.sample_head(view(spark, sf_dir, "catalog"), "object_id")


@query
def sample_random(spark, sf_dir):
    return profile.sample_random(view(spark, sf_dir, "catalog"), "object_id", 20)


@query
def spatial_stats(spark, sf_dir):
    return profile.numeric_stats(view(spark, sf_dir, "gaps"), ["ra", "z_nan"], moments=False)


@query
def footer_stats(spark, sf_dir):
    """Statistics of a file: whole numbers from its footers, a scan for the floats only."""
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
    return profile.footer_stats(spark, f"{sf_dir}/lineitem.parquet", columns)


@query
def row_col_counts(spark, sf_dir):
    return profile.shape(view(spark, sf_dir, "catalog"))


@query
def semantic_warnings(spark, sf_dir):
    df = view(spark, sf_dir, "gaps").select(
        "object_id", F.col("z_text").alias("OBSRA"), F.col("z_nan").alias("z_spec"), F.col("nothing").alias("z_phot")
    )
    return profile.semantic_warnings(df)


# --- quality ------------------------------------------------------------------------------


@query
def qa_row_count(spark, sf_dir):
    return quality.row_count(view(spark, sf_dir, "catalog"))


@query
def qa_missing(spark, sf_dir):
    df = quality.missing_counts(view(spark, sf_dir, "gaps"))
    return df.withColumn("missing_pct", F.round("missing_pct", 9))


@query
def qa_numeric_diag(spark, sf_dir):
    return quality.numeric_diagnostics(view(spark, sf_dir, "gaps"), "z_inf", (0.5, 2.0))


@query
def qa_numeric_diag_text(spark, sf_dir):
    return quality.numeric_diagnostics(view(spark, sf_dir, "gaps"), "z_text", (10, 20))


@query
def qa_spatial_diag(spark, sf_dir):
    return quality.spatial_diagnostics(view(spark, sf_dir, "gaps"), "ra", "dec")


@query
def qa_range(spark, sf_dir):
    return quality.numeric_range(view(spark, sf_dir, "gaps"), "z_inf")


@query
def qa_hist1d(spark, sf_dir):
    return quality.histogram1d(view(spark, sf_dir, "catalog"), "z_spec", 50, (0.0, 4.0))


@query
def qa_hist1d_auto(spark, sf_dir):
    return quality.histogram1d(view(spark, sf_dir, "catalog"), "z_spec", 37)


@query
def qa_hist1d_wide(spark, sf_dir):
    return quality.histogram1d(view(spark, sf_dir, "wide_catalog"), "z_spec", 50, (0.0, 4.0))


@query
def qa_hist2d(spark, sf_dir):
    return quality.histogram2d(view(spark, sf_dir, "catalog"), "ra", "dec")


@query
def qa_hist2d_wide(spark, sf_dir):
    return quality.histogram2d(view(spark, sf_dir, "wide_catalog"), "ra", "dec")


@query
def qa_value_counts(spark, sf_dir):
    return quality.value_counts(view(spark, sf_dir, "gaps"), "flag")


@query
def qa_category_counts(spark, sf_dir):
    return quality.value_counts(view(spark, sf_dir, "gaps"), "note", drop_missing=True)


@query
def qa_describe(spark, sf_dir):
    df = view(spark, sf_dir, "gaps").select("ra", "z_nan", "nothing")
    wide = quality.describe(df)
    return wide.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query
def qa_describe_wide(spark, sf_dir):
    df = view(spark, sf_dir, "wide_catalog").select("ra", "z_spec", "z_phot")
    wide = quality.describe(df)
    return wide.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query
def qa_warnings(spark, sf_dir):
    df = view(spark, sf_dir, "gaps").select("ra", "dec", "z_nan", "nothing", "note")
    return quality.data_warnings(
        df,
        spatial=("ra", "dec"),
        numeric=[("z_nan", (100.0, 200.0)), ("nothing", None)],
        categorical=["note", "nothing"],
    )


# --- footprints ---------------------------------------------------------------------------


@query
def footprint_usable(spark, sf_dir):
    return footprint.curve_usable(view(spark, sf_dir, "vertices"))


@query
def footprint_curves(spark, sf_dir):
    return footprint.ordered_curves(view(spark, sf_dir, "vertices"))


@query
def footprint_segments(spark, sf_dir):
    return footprint.curve_segments(view(spark, sf_dir, "vertices")).select("curve", "segment", "position")


# --- sky tiles ----------------------------------------------------------------------------


def _indexed(spark: SparkSession, sf_dir: str, name: str = "catalog") -> DataFrame:
    return add_sky_index(view(spark, sf_dir, name).select("object_id", "ra", "dec"), "ra", "dec")


def _tile_map(indexed: DataFrame) -> tiles.TileMap:
    return tiles.build_tile_map(tiles.count_cells(indexed, TILE_ORDER), TILE_ROWS, TILE_ORDER)


@query
def healpix_index(spark, sf_dir):
    df = view(spark, sf_dir, "catalog").select("object_id", "ra", "dec")
    for order in (3, 6):
        df = add_sky_index(df, "ra", "dec", order, f"cell_{order}")
    return add_sky_index(df, "ra", "dec").drop("ra", "dec")


@query
def healpix_index_wide(spark, sf_dir):
    df = _indexed(spark, sf_dir, "wide_catalog")
    return df.groupBy(F.shiftright(INDEX_COLUMN, 50).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query
def partition_map(spark, sf_dir):
    cells = tiles.count_cells(_indexed(spark, sf_dir), TILE_ORDER)
    return tiles.partition_map(cells, TILE_ORDER, TILE_ROWS)


@query
def tile_assign(spark, sf_dir):
    df = _indexed(spark, sf_dir)
    return tiles.assign_tiles(df, _tile_map(df)).drop(INDEX_COLUMN, "ra", "dec")


@query
def tile_sorted(spark, sf_dir):
    df = _indexed(spark, sf_dir)
    found = _tile_map(df)
    together = tiles.cluster_tiles(tiles.assign_tiles(df, found), found, "object_id")
    place = F.monotonically_increasing_id()
    first = F.min("place").over(Window.partitionBy("Norder", "Npix"))
    ranked = together.withColumn("place", place).withColumn("rank", (F.col("place") - first + 1).cast("bigint"))
    return ranked.drop(INDEX_COLUMN, "ra", "dec", "place")


@query
def margin_cache(spark, sf_dir):
    df = _indexed(spark, sf_dir)
    found = _tile_map(df)
    stored = as_table(tiles.assign_tiles(df, found), "assigned")
    return tiles.margin_rows(stored, found, "ra", "dec", 900.0).drop(INDEX_COLUMN)


# --- whole jobs ---------------------------------------------------------------------------


@query
def x_curate_pipeline(spark, sf_dir):
    return curate(view(spark, sf_dir, "catalog"), PIPELINE)


@query
def x_curate_wide(spark, sf_dir):
    return curate(view(spark, sf_dir, "wide_catalog"), PIPELINE)


@query
def x_curate_write(spark, sf_dir):
    path = scratch_path(spark, "curated")
    curate_to(view(spark, sf_dir, "catalog"), PIPELINE, path)
    return spark.read.parquet(path)


@query
def x_curate_spatial(spark, sf_dir):
    source = _collection(spark, view(spark, sf_dir, "catalog"), None)
    path = scratch_path(spark, "recurated")
    curate_to_collection(
        skyloom.read_spatial(spark, source), PIPELINE, path, name="main", margin_arcsec=60.0, max_tile_rows=2000
    )
    return skyloom.read_spatial(spark, path).drop(INDEX_COLUMN)


@query
def x_prepare(spark, sf_dir):
    df = view(spark, sf_dir, "catalog")
    parts = []
    for q in ("F", "O", "P"):
        parts.append(scratch_path(spark, f"part-{q}"))
        df.where(F.col("quality") == q).write.parquet(parts[-1])
    path = scratch_path(spark, "prepared")
    skyloom.prepare(spark, parts, path)
    return spark.read.parquet(path)


@query
def x_prepare_union(spark, sf_dir):
    """Sources of which one lacks a column."""
    df = view(spark, sf_dir, "catalog").select("object_id", "quality", "v_kms")
    parts = []
    for q in ("F", "O", "P"):
        parts.append(scratch_path(spark, f"part-{q}"))
        part = df.where(F.col("quality") == q)
        (part.drop("v_kms") if q == "O" else part).write.parquet(parts[-1])
    path = scratch_path(spark, "prepared")
    skyloom.prepare(spark, parts, path, schema_policy="union", target_partition_bytes=1 << 20)
    return spark.read.parquet(path)


@query
def x_inspect(spark, sf_dir):
    """The statistics of an inspection report."""
    df = view(spark, sf_dir, "gaps").select("object_id", "ra", "z_nan", "nothing", "flag", "note")
    stats = skyloom.inspect(df, stats_mode="all", sample_key="object_id")["numeric_stats"]
    rows = [(name, *s.values()) for name, s in stats.items() if name != "object_id"]
    made = spark.createDataFrame(rows, profile.STATS)
    return made.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def _job(spark, sf_dir, table):
    """One table of a quality job over all rows."""
    plots = {
        "spatial": {"ra_column": "ra", "dec_column": "dec"},
        "redshift": {"column": "z_spec", "bins": 37},
        "redshift_error": {"column": "z_phot", "range": [0.0, 4.0]},
        "categorical": [{"column": "quality"}],
    }
    df = view(spark, sf_dir, "catalog").select("ra", "dec", "z_spec", "z_phot", "quality")
    return skyloom.qa(df, plots)[table]


@query
def x_qa_row_count(spark, sf_dir):
    return _job(spark, sf_dir, "row_count")


@query
def x_qa_missing(spark, sf_dir):
    return _job(spark, sf_dir, "missing").withColumn("missing_pct", F.round("missing_pct", 9))


@query
def x_qa_describe(spark, sf_dir):
    digits = {c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")}
    return _job(spark, sf_dir, "describe").withColumns(digits)


@query
def x_qa_redshift_histogram(spark, sf_dir):
    return _job(spark, sf_dir, "redshift_histogram")


@query
def x_qa_counts(spark, sf_dir):
    return _job(spark, sf_dir, "counts_quality")


@query
def x_qa_tables(spark, sf_dir):
    """The warnings of a full quality job with a footprint."""
    plots = {
        "spatial": {"ra_column": "ra", "dec_column": "dec"},
        "redshift": {"column": "z_nan", "range": [100.0, 200.0]},
        "quality": {"column": "note"},
    }
    df = view(spark, sf_dir, "gaps").select("ra", "dec", "z_nan", "note")
    few = view(spark, sf_dir, "vertices").withColumn("ring_type", F.lit("interior"))
    return skyloom.qa(df, plots, {"Survey edge": few})["warnings"]

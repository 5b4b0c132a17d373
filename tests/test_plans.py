"""What the physical plans must look like for the work to scale."""

import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
import skyloom
from checks.duck_sql import SQL
from checks.spark_queries import QUERIES
from skyloom.functions.healpix import add_sky_index
from skyloom.operators import profile, quality, tiles, validate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    """A stored catalog with plain columns, as a user has it."""
    path = str(tmp_path_factory.mktemp("plans") / "catalog")
    names = [F.col("object_id"), F.col("ra"), F.col("dec"), F.col("z_spec").alias("z"), F.col("quality"), F.col("v_kms")]
    from checks.views import view

    view(spark, SF, "catalog").select(*names).write.parquet(path)
    return spark.read.parquet(path)


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange\b", plan_of(df)))


def spec(**redshift):
    return {
        "column_selection": ["object_id", "ra", "dec", "z"],
        "coordinates": {"ra_column": "ra", "dec_column": "dec"},
        "redshift": {"column": "z", "invalid_policy": "flag", **redshift},
    }


def test_curation_is_a_map_with_pushed_filters_and_pruned_columns(catalog):
    plan = plan_of(skyloom.curate(catalog, spec(filters=[{"op": ">", "value": 0.5}, {"op": "<", "value": 3}])))
    assert "Exchange" not in plan and "Python" not in plan
    assert "GreaterThan(z,0.5)" in plan and "LessThan(z,3.0)" in plan
    assert re.search(r"ReadSchema: struct<object_id:bigint,ra:double,dec:double,z:double>", plan)


def test_a_filter_on_a_velocity_redshift_reaches_the_scan(catalog):
    job = {
        "transformations": [{"type": "velocity_to_redshift", "velocity_column": "v_kms", "output_column": "zv"}],
        "coordinates": {"ra_column": "ra", "dec_column": "dec"},
        "redshift": {"column": "zv", "invalid_policy": "keep", "filters": [{"op": ">=", "value": 0.5}]},
    }
    out = skyloom.curate(catalog, job)
    assert "GreaterThanOrEqual(v_kms," in plan_of(out)
    want = catalog.where("v_kms / 299792.458 >= 0.5 and v_kms / 299792.458 < 20").count()
    assert 0 < want < catalog.count() and out.count() == want
    recast = {"type": "cast", "column": "v_kms", "dtype": "float32"}
    changed = skyloom.curate(catalog, {**job, "transformations": [recast, *job["transformations"]]})
    assert "GreaterThanOrEqual(v_kms," not in plan_of(changed)


def test_validation_reads_three_columns(catalog):
    plan = plan_of(validate.standard_ranges(catalog, "ra", "dec", "z"))
    assert "ReadSchema: struct<ra:double,dec:double,z:double>" in plan


@pytest.mark.parametrize(
    "build",
    [
        lambda df: profile.numeric_stats(df),
        lambda df: quality.missing_counts(df),
        lambda df: quality.spatial_diagnostics(df, "ra", "dec"),
        lambda df: quality.data_warnings(df, ("ra", "dec"), [("z", (0, 1))], ["quality"]),
        lambda df: profile.semantic_warnings(df),
    ],
)
def test_reductions_exchange_one_partial_row_per_task(catalog, build):
    df = build(catalog)
    plan = plan_of(df)
    assert exchanges(df) == 1 and "SinglePartition" in plan and "partial_" in plan
    assert "Python" not in plan and "Join" not in plan


def test_histograms_aggregate_before_they_shuffle(catalog):
    plan = plan_of(quality.histogram2d(catalog, "ra", "dec"))
    assert plan.count("Exchange hashpartitioning(ix") == 1 and "partial_count" in plan
    assert "ReadSchema: struct<ra:double,dec:double>" in plan


def test_uniques_are_made_distinct_then_cut_before_ranking(catalog):
    plan = plan_of(profile.categorical_uniques(catalog, ["quality"]))
    assert "WindowGroupLimit" in plan
    assert "ReadSchema: struct<quality:string>" in plan


def test_random_sample_keeps_the_top_of_each_task(catalog):
    assert "TakeOrderedAndProject" in plan_of(profile.sample_random(catalog, "object_id"))


@pytest.mark.parametrize("max_rows", [100_000, 100, 2])
def test_tiles_take_one_exchange_at_every_map_size(catalog, max_rows):
    indexed = add_sky_index(catalog, "ra", "dec")
    found = tiles.build_tile_map(tiles.count_cells(indexed, 6), max_rows, 6)
    assigned = tiles.assign_tiles(indexed, found)
    assert "Exchange" not in plan_of(assigned) and "Join" not in plan_of(assigned)
    together = tiles.cluster_tiles(assigned, found)
    assert exchanges(together) == 1 and "Join" not in plan_of(together)


def test_many_files_of_one_schema_are_one_scan(spark, catalog, tmp_path):
    paths = [str(tmp_path / f"p{i}.csv") for i in range(4)]
    for i, p in enumerate(paths):
        with open(p, "w") as handle:
            handle.write("id,z\n%d,%s\n" % (i, "x" if i == 3 else "1"))
    df = skyloom.read_sources(spark, paths)
    assert plan_of(df).count("FileScan") == 1
    assert df.schema["z"].dataType.simpleString() == "string" and df.count() == 4


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns)) > 0
    df.write.format("noop").mode("overwrite").save()


def test_no_query_needs_an_unsized_product(spark):
    for name in ("qa_hist1d", "qa_missing", "numeric_stats", "footprint_segments", "tile_assign", "partition_map"):
        plan = plan_of(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(SQL) == {"margin_cache", "scan_spatial_margin"}


def test_scratch_scopes_delete_their_tables(spark):
    from skyloom.session import as_table, path_exists, scratch_scope

    folder = lambda df: df.inputFiles()[0].rsplit("/", 1)[0]
    with scratch_scope(spark):
        with scratch_scope(spark):
            gone, kept = folder(as_table(spark.range(3), "gone")), as_table(spark.range(4), "kept", keep=True)
            assert path_exists(spark, gone)
        assert not path_exists(spark, gone) and kept.count() == 4
        held = folder(kept)
    assert not path_exists(spark, held)
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        failed, left = folder(as_table(spark.range(3), "failed")), as_table(spark.range(5), "left", keep=True)
        1 / 0
    assert not path_exists(spark, failed) and left.count() == 5

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import plan_of
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import skyloom
from skyloom import CatalogError
from skyloom.operators import footprint, profile, quality
from skyloom.operators.quantiles import exact_quantiles

NAN, INF = math.nan, math.inf


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_candidates_of_known_names():
    names = "OBSRA ra_j2000_h Alpha_J2000 OBSDEC dec_j2000_d Delta_J2000 z_helio qual ZWARN ZWARNING ZWARNING_NOQSO".split()
    names += ["ETA_TYPE", "ra", "xra", "name", "comment"]
    found = profile.candidate_columns(names)
    assert found["ra"] == ["OBSRA", "ra_j2000_h", "Alpha_J2000", "ra"]
    assert found["dec"] == ["OBSDEC", "dec_j2000_d", "Delta_J2000"]
    assert found["redshift"] == ["z_helio"]
    assert found["quality"] == ["qual", "ZWARN", "ZWARNING", "ZWARNING_NOQSO"]
    assert found["object_type"] == ["ETA_TYPE"]
    assert found["redshift_error"] == found["id"] == []
    assert profile.candidate_columns(["zz"], profile.patterns_with({"redshift": ["^zz$"]}))["redshift"] == ["zz"]


def test_numeric_stats_of_gaps(spark):
    df = spark.createDataFrame([(NAN, 1.0), (NAN, NAN)], "empty double, single double")
    stats = by(profile.numeric_stats(df), "column")
    assert tuple(stats["empty"])[1:] == (0, 2, None, None, None, None)
    assert tuple(stats["single"])[1:] == (1, 1, 1.0, None, 1.0, 1.0)
    assert profile.numeric_stats(df.select(F.lit("x").alias("t"))).count() == 0


def test_stats_in_batches(spark, monkeypatch):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    monkeypatch.setattr(profile, "STATS_BATCH", 2)
    assert {r["column"]: r["mean"] for r in profile.numeric_stats(df).collect()} == {"a": 1.0, "b": 2.0, "c": 3.0}


def test_merged_stats_equal_global(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 9, 500), rng.normal(1e6, 1, 500))] + [(3, NAN), (99, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    merged = profile.numeric_stats(df.repartition(9, "g"), ["v"]).first()
    whole = profile.numeric_stats(df.coalesce(1), ["v"]).first()
    assert (merged["count"], merged["null_count"]) == (whole["count"], whole["null_count"]) == (500, 2)
    for key in ("mean", "std", "min", "max"):
        assert merged[key] == pytest.approx(whole[key], rel=1e-9)


def test_uniques(spark):
    df = spark.createDataFrame([(" b ", True), ("a", False), ("", None), (None, True), ("b", True)], "s string, f boolean")
    got = profile.categorical_uniques(df, limit=2).orderBy("column", "rank").collect()
    assert [(r["column"], r["value"]) for r in got] == [("f", "False"), ("f", "True"), ("s", "a"), ("s", "b")]
    assert profile.categorical_uniques(df, ["s"], limit=1).collect()[0]["value"] == "a"


def test_uniques_of_a_column_with_many_values(spark):
    """More values than hash buckets: the bound of the first scan must not lose a wanted one."""
    df = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.lit("same").alias("s"))
    got = profile.categorical_uniques(df, limit=5).orderBy("column", "rank").collect()
    want = sorted(f"k{i}" for i in range(20_000))[:5]
    assert [(r["column"], r["value"]) for r in got] == [("k", v) for v in want] + [("s", "same")]


def test_random_sample_ignores_partitioning(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r["k"] for r in profile.sample_random(df.repartition(7), "k", 10).collect()}
    b = {r["k"] for r in profile.sample_random(df.coalesce(1), "k", 10).collect()}
    assert a == b and len(a) == 10
    assert a != {r["k"] for r in profile.sample_random(df, "k", 10, seed=7).collect()}


def test_semantic_warnings(spark):
    rows = [("a", "b", None, 0.1, 0.2, "k"), ("a", "b", NAN, 0.1, 0.2, "k"), ("a", "b", None, 0.1, 0.2, "k")]
    rows.append(("a", "b", 1.0, 0.1, 0.2, "k"))
    df = spark.createDataFrame(rows, "RA_DEG string, dec string, z double, z_spec double, best_z double, kind string")
    got = [r["message"] for r in profile.semantic_warnings(df).collect()]
    assert got == [
        "Multiple redshift candidate columns were found: z, z_spec, best_z.",
        "RA candidate columns are not numeric: RA_DEG.",
        "DEC candidate columns are not numeric: dec.",
        "Redshift candidate columns have many null values: z (75.0% null).",
    ]
    none = profile.semantic_warnings(df.select("kind"))
    assert [r["code"] for r in none.collect()] == ["no_ra", "no_dec", "no_redshift"]


def test_inspect_report(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 1.0, i * 0.1, "G", [1.0]) for i in range(20)], "object_id long, ra double, z double, class string, vec array<double>")
    report = skyloom.inspect(df, "S", stats_mode="all", sample_key="object_id")
    assert report["n_rows"] == 20 and report["n_columns"] == 5
    assert report["numeric_stats"]["z"]["count"] == 20
    assert report["categorical_uniques"] == {"class": ["G"]}
    assert len(report["sample"]) == 5 and list(report["sample"][0])[0] == "ra"
    assert "No DEC candidate columns were found." in report["warnings"]
    assert any("Vector columns" in w for w in report["warnings"])
    skyloom.write_report(spark, report, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").exists()
    few = skyloom.inspect(df, column_selection=["z"], stats_mode="none", sample_max_columns=0)
    assert few["n_columns_selected"] == 1 and few["sample"] == [] and few["numeric_stats"] == {}
    with pytest.raises(CatalogError, match="selected columns absent"):
        skyloom.inspect(df, column_selection=["absent"])
    with pytest.raises(CatalogError):
        profile.stats_columns(df, mode="some")


def test_histogram_golden(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (NAN,), (0.4,)], "z double")
    rows = quality.histogram1d(df, "z", 3).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [1, 1, 1]
    np.testing.assert_allclose([r["lower"] for r in rows] + [rows[-1]["upper"]], [0.1, 0.2, 0.3, 0.4])


@pytest.mark.parametrize("values", [[5.0], [5.0, 5.0], [], [None], [1.0, INF], [-3.0, 2.0]])
def test_histogram_ranges(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "z double")
    rows = quality.histogram1d(df, "z", 4).orderBy("bin").collect()
    present = np.array([v for v in values if v is not None])
    low, high = (present.min(), present.max()) if len(present) else (NAN, NAN)
    if not (np.isfinite(low) and np.isfinite(high)):
        low, high = 0.0, 1.0
    elif low == high:
        low, high = low - 0.5, high + 0.5
    counts, edges = np.histogram(present[np.isfinite(present)], bins=np.linspace(low, high, 5))
    assert [r["n"] for r in rows] == counts.tolist()
    assert [r["lower"] for r in rows] == edges[:-1].tolist()


def test_bins_agree_with_an_edge_search(spark):
    """Values on and next to every edge, where plain division goes wrong."""
    for low, high, bins in ((0.0, 4.0, 50), (-0.3, 7.1, 37), (-math.pi, math.pi, 179), (1e-9, 1e9, 11)):
        edges = np.linspace(low, high, bins + 1)
        values = np.concatenate([edges, np.nextafter(edges, -np.inf), np.nextafter(edges, np.inf)])
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        got = quality.histogram1d(df, "v", bins, (low, high)).orderBy("bin").collect()
        assert [r["n"] for r in got] == np.histogram(values, bins=edges)[0].tolist()


def test_sky_density_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    ra, dec = rng.uniform(0, 360, 3000), rng.uniform(-90, 90, 3000)
    ra[:4], dec[:4] = [0, 180, 179.999, 359.999], [90, -90, 0, 45]
    df = spark.createDataFrame([(float(a), float(d)) for a, d in zip(ra, dec)] + [(NAN, 1.0), (1.0, INF)], "ra double, dec double")
    got = {(r["ix"], r["iy"]): r["n"] for r in quality.histogram2d(df, "ra", "dec").collect()}
    x, y = -np.deg2rad(((ra + 180) % 360) - 180), np.deg2rad(dec)
    h, _, _ = np.histogram2d(x, y, bins=[np.linspace(-np.pi, np.pi, 180), np.linspace(-np.pi / 2, np.pi / 2, 90)])
    assert got == {(int(i), int(j)): int(h[i, j]) for i, j in np.argwhere(h > 0)}


def test_diagnostics_golden(spark):
    df = spark.createDataFrame([(10.0, 0.0, 0.1), (NAN, INF, NAN), (361.0, -91.0, 4.0)], "ra double, dec double, z double")
    assert {r["column"]: r["missing"] for r in quality.missing_counts(df).collect()} == {"ra": 1, "dec": 0, "z": 1}
    assert tuple(quality.spatial_diagnostics(df, "ra", "dec").first()) == (1, 1, 1, 1, 2)
    assert tuple(quality.numeric_diagnostics(df, "z", (0, 1)).first()) == (2, 1)
    empty = df.where("false")
    assert {r["missing_pct"] for r in quality.missing_counts(empty).collect()} == {0.0}


def test_value_counts(spark):
    df = spark.createDataFrame([(2.0,), (NAN,), (None,), (1.0,), (2.0,)], "q double")
    assert [tuple(r) for r in quality.value_counts(df, "q").collect()] == [(None, 2), (1.0, 1), (2.0, 2)]
    assert [tuple(r) for r in quality.value_counts(df, "q", drop_missing=True).collect()] == [(1.0, 1), (2.0, 2)]


def test_describe(spark):
    df = spark.createDataFrame([(float(v), None) for v in (1, 2, 3, 4, NAN)], "v double, n double")
    rows = by(quality.describe(df), "column")
    assert tuple(rows["v"])[1:] == (4, 2.5, pytest.approx(1.2909944487358056), 1.0, 1.75, 2.5, 3.25, 4.0)
    assert tuple(rows["n"])[1:] == (0, None, None, None, None, None, None, None)
    assert by(quality.describe(df, approximate=True), "column")["v"]["q50"] in (2.0, 3.0)


@pytest.mark.parametrize("kind", ["uniform", "hot", "two", "heavy"])
def test_exact_quantiles_under_refinement(spark, kind):
    """A tiny threshold and a crude sketch force many rounds; hot values must not stall them."""
    rng = np.random.default_rng(3)
    n = 20_000
    data = {
        "uniform": rng.random(n),
        "hot": np.where(rng.random(n) < 0.4, 7.25, rng.normal(7.25, 5, n)),
        "two": rng.integers(0, 2, n).astype(float),
        "heavy": np.exp(rng.normal(0, 40, n)) * rng.choice([-1, 1], n),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    fractions = (0.0, 0.01, 0.25, 0.5, 0.6, 0.75, 1.0)
    got = exact_quantiles(df, ["v"], fractions, few=3, accuracy=20)["v"]
    np.testing.assert_allclose(got, np.quantile(data, fractions), rtol=1e-12)


def counting(df):
    """The same rows, and a counter of how many of them were read."""
    read = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), read


@pytest.mark.parametrize("columns", [1, 12])
def test_quantiles_take_two_scans(spark, columns):
    """Sketches, then counts together with the rows inside the brackets, for any number of columns."""
    n = 30_000
    rng = np.random.default_rng(5)
    data = rng.normal(size=(n, columns))
    frame = pa.table({f"v{i}": data[:, i] for i in range(columns)})
    df, read = counting(spark.createDataFrame(frame))
    got = quality.describe(df).collect()
    assert read.value == 2 * n
    for i, r in enumerate(got):
        np.testing.assert_allclose([r["q25"], r["q50"], r["q75"]], np.quantile(data[:, i], [0.25, 0.5, 0.75]), rtol=1e-12)


def test_scalar_facts_of_the_jobs_take_one_pass(spark):
    """Row count, missing values, warnings, ranges and the first pass of the description are read together."""
    rows = [(float(i % 360), 1.0, float(i), "a") for i in range(1000)]
    df, read = counting(spark.createDataFrame(rows, "ra double, dec double, z double, kind string"))
    plots = {
        "spatial": {"ra_column": "ra", "dec_column": "dec"},
        "redshift": {"column": "z"},
        "categorical": [{"column": "kind"}],
    }
    made = skyloom.qa(df, plots)
    assert read.value == 2000  # the second scan reads the few values of so small a catalog
    assert {t: made[t].count() for t in ("row_count", "missing", "warnings", "describe")} == {
        "row_count": 1, "missing": 4, "warnings": 0, "describe": 3,
    }
    assert read.value == 2000
    assert made["redshift_histogram"].agg(F.min("lower"), F.max("upper"), F.sum("n")).first()[:] == (0.0, 999.0, 1000)

    df, read = counting(spark.createDataFrame(rows, "ra double, dec double, z double, kind string"))
    report = skyloom.inspect(df, stats_mode="candidates", sample_max_columns=0)
    assert report["n_rows"] == 1000 and report["numeric_stats"]["z"]["max"] == 999.0
    assert read.value == 1000


def test_footer_stats(spark, tmp_path):
    """Whole numbers come from footers, floats (which may be NaN) and files without extremes from a scan."""
    path = str(tmp_path / "t")
    spark.createDataFrame(
        [(1, 5, 1.0), (None, 7, NAN), (3, -2, None)], "a bigint, b int, f double"
    ).coalesce(1).write.parquet(path)
    plan = plan_of(profile.footer_frame(spark, path, ["a", "b"]))
    assert "MIN(a)" in plan and "COUNT(b)" in plan and "ReadSchema: struct<count(*)" in plan
    got = by(profile.footer_stats(spark, path), "column")
    assert tuple(got["a"])[1:] == (2, 1, None, None, 1.0, 3.0)
    assert tuple(got["b"])[1:] == (3, 0, None, None, -2.0, 7.0)
    assert tuple(got["f"])[1:] == (1, 2, None, None, 1.0, 1.0)
    scanned = by(profile.numeric_stats(spark.read.parquet(path), moments=False), "column")
    assert got == scanned
    report = skyloom.inspect(spark.read.parquet(path), stats_mode="all", footers=path)
    assert report["numeric_stats"]["b"] == {
        "count": 3, "null_count": 0, "mean": None, "std": None, "min": -2.0, "max": 7.0,
    }

    empty = str(tmp_path / "groups.parquet")
    pq.write_table(pa.table({"a": pa.array([None, None, 4, 9], pa.int64())}), empty, row_group_size=2)
    assert tuple(profile.footer_stats(spark, empty).first())[1:] == (2, 2, None, None, 4.0, 9.0)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_exact_quantiles_of_small_lists(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = exact_quantiles(df, ["v"], (0.25, 0.5, 0.75), few=2)["v"]
    np.testing.assert_allclose(got, np.quantile(values, [0.25, 0.5, 0.75]), rtol=1e-9, atol=1e-9)


def test_data_warnings_of_an_empty_catalog(spark):
    df = spark.createDataFrame([], "ra double, dec double, z double, q string")
    got = quality.data_warnings(df, ("ra", "dec"), [("z", (0.0, 1.0))], ["q"])
    assert {r["code"] for r in got.collect()} == {"empty_catalog", "no_valid_pairs", "no_finite_values", "no_categories"}


def region(spark, points, ring="exterior", regions=None):
    rows = [((regions or [0] * len(points))[i], ring, i, ra, 0.0) for i, ra in enumerate(points)]
    return spark.createDataFrame(rows, "region_id int, ring_type string, vertex_id int, ra_deg double, dec_deg double")


def reference_segments(points):
    x = [NAN if p is None else -math.radians(((p + 180) % 360) - 180) for p in points]
    cuts = [i + 1 for i in range(len(x) - 1) if abs(x[i + 1] - x[i]) > math.pi]
    bounds = [0, *cuts, len(x)]
    return [list(range(a, b)) for a, b in zip(bounds, bounds[1:]) if b - a > 1]


@pytest.mark.parametrize("block", [1, 2, 3, 100])
@pytest.mark.parametrize(
    "points", [[10, 20, 30], [170, 190, 170, 160], [179, 181], [5], [], [170, 190, 200, 150, 140, 181], [10, None, 20]]
)
def test_segments_across_blocks(spark, monkeypatch, points, block):
    monkeypatch.setattr(footprint, "VERTEX_BLOCK", block)
    rows = footprint.curve_segments(region(spark, [None if p is None else float(p) for p in points])).collect()
    grouped = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        grouped.setdefault(r["segment"], []).append(int(r["position"]))
    assert list(grouped.values()) == reference_segments(points)


def test_curve_order_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(footprint, "VERTEX_BLOCK", 2)
    rows = footprint.ordered_curves(region(spark, [3.0, 1.0, 2.0, 9.0, 4.0])).orderBy("place").collect()
    assert [(r["place"], r["ra"]) for r in rows] == [(1, 3.0), (2, 1.0), (3, 2.0), (4, 9.0), (5, 4.0)]


@pytest.mark.parametrize("apart", [100_000, 1, 0])
def test_blocks_are_of_like_size_however_ids_are_spread(spark, monkeypatch, apart):
    """Ids far apart, dense, or (0) all missing: no window of the curve, nor of its blocks, grows with the spread of the ids."""
    monkeypatch.setattr(footprint, "VERTEX_BLOCK", 100)
    n = 3000
    rows = [("r", "exterior", i * apart if apart else None, float(i * 37 % 360), float(i % 90)) for i in range(n)]
    schema = "region_id string, ring_type string, vertex_id bigint, ra_deg double, dec_deg double"
    df = spark.createDataFrame(rows, schema).repartition(4)
    sizes = [r["count"] for r in footprint.blocked_curves(df).groupBy("curve", "block").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 400 and len(sizes) <= 30
    ordered = footprint.ordered_curves(df).orderBy("place").collect()
    assert [r["place"] for r in ordered] == list(range(1, n + 1))
    if apart:
        assert [r["ra"] for r in ordered] == [r[3] for r in rows]
    monkeypatch.setattr(footprint, "VERTEX_BLOCK", 10**9)
    assert [r["ra"] for r in footprint.ordered_curves(df).orderBy("place").collect()] == [r["ra"] for r in ordered]


def test_footprint_usability(spark):
    assert not footprint.curve_usable(region(spark, [10.0])).first()[0]
    assert not footprint.curve_usable(region(spark, [10.0, 11.0], ring="interior")).first()[0]
    assert not footprint.curve_usable(region(spark, [10.0, 11.0], regions=[0, 1])).first()[0]
    assert footprint.curve_usable(region(spark, [10.0, 11.0])).first()[0]
    limit = spark.createDataFrame([(10.0, 20.0), (11.0, 21.0)], "ra_center double, dec_limit double")
    assert footprint.curve_usable(limit).first()[0]
    assert footprint.curve_segments(limit).count() == 2
    got = skyloom.qa(region(spark, [1.0]), footprints={"Edge": region(spark, [10.0])})["warnings"].collect()
    assert [r["message"] for r in got] == ["Edge: footprint has no curve with at least two finite points."]

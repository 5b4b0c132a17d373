import math
import os

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from skyloom import CatalogError, curate_to, curate_to_collection, read_margin, read_spatial, write_collection
from skyloom.functions import tile_distance
from skyloom.functions.healpix import INDEX_COLUMN, add_face_xy, add_sky_index, coarser
from skyloom.functions.tile_distance import distance_to_tile, face_to_vector
from skyloom.operators import tiles
from skyloom.session import as_table, read_text, write_text
from skyloom.sinks.collection import add_margin
from skyloom.sources.collection import CollectionLayout


def sky(spark, n=4000, seed=0):
    """Uniform points, a dense clump, points at the poles and on the face borders."""
    rng = np.random.default_rng(seed)
    ra = np.concatenate([rng.uniform(0, 360, n), rng.normal(45.0, 0.5, n), np.arange(0, 360, 15.0)])
    dec = np.concatenate([np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.normal(42.0, 0.5, n), np.tile([89.999, -89.999, 41.8103, -41.8103], 6)])
    rows = [(i, float(a % 360), float(d)) for i, (a, d) in enumerate(zip(ra, dec))]
    return spark.createDataFrame(rows, "id long, ra double, dec double")


def vectors(ra, dec):
    lon, lat = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def test_index_is_hierarchical_and_inverts(spark):
    df = add_sky_index(sky(spark), "ra", "dec")
    for order in (0, 1, 3, 10):
        both = add_sky_index(df, "ra", "dec", order, "k")
        assert both.where(coarser(F.col(INDEX_COLUMN), order) != F.col("k")).count() == 0
    pdf = add_face_xy(df).toPandas()
    size = 2.0**29
    back = face_to_vector(pdf["__face"].to_numpy(), (pdf["__x"].to_numpy() + 0.5) / size, (pdf["__y"].to_numpy() + 0.5) / size)
    assert np.abs(back - vectors(pdf.ra.to_numpy(), pdf.dec.to_numpy())).max() < 1e-8


def test_index_of_known_fields_and_gaps(spark):
    df = spark.createDataFrame([(242.75, 54.5), (8.75, -43.5), (None, 1.0), (1.0, math.nan), (math.nan, 80.0), (None, -80.0), (1.0, None)], "ra double, dec double")
    got = [r["k"] for r in add_sky_index(df, "ra", "dec", 0, "k").collect()]
    assert got == [2, 8, None, None, None, None, None]


def test_filters_on_the_index_stay_compilable(spark):
    df = add_sky_index(spark.range(50).select((F.col("id") * 7.0).alias("ra"), (F.col("id") - 25.0).alias("dec")), "ra", "dec")
    picked = df.where((F.col(INDEX_COLUMN) > 0) & (coarser(F.col(INDEX_COLUMN), 3) != 5))
    assert picked.count() <= 50
    assert "Python" not in plan_of(picked)


def test_smallest_stretch_is_above_the_bound():
    rng = np.random.default_rng(0)
    n, h = 200_000, 1e-6
    face, x, y = rng.integers(0, 12, n), rng.random(n) * 0.999, rng.random(n) * 0.999
    turn = rng.random(n) * 2 * np.pi
    step = face_to_vector(face, x + h * np.cos(turn), y + h * np.sin(turn)) - face_to_vector(face, x, y)
    assert (np.sqrt((step**2).sum(axis=0)) / h).min() > tiles.MIN_STRETCH


def tile_map(df, rows, order):
    return tiles.build_tile_map(tiles.count_cells(df, order), rows, order)


def test_tiles_hold_every_row_once(spark):
    df = add_sky_index(sky(spark), "ra", "dec")
    found = tile_map(df, 500, 5)
    table = found.table.toPandas()
    assert len(found.orders) > 2 and found.n_rows == df.count() == table.n_rows.sum()
    assert ((table.n_rows <= 500) | (table.Norder == 5)).all()
    covered = [set(range(p << 2 * (5 - o), (p + 1) << 2 * (5 - o))) for o, p in zip(table.Norder, table.Npix)]
    assert sum(map(len, covered)) == len(set().union(*covered))
    assigned = tiles.assign_tiles(df, found)
    counts = assigned.groupBy("Norder", "Npix").count().toPandas()
    merged = counts.merge(table, on=["Norder", "Npix"], how="outer")
    assert (merged["count"] == merged["n_rows"]).all()


def test_byte_limit_splits_tiles_too(spark):
    df = add_sky_index(sky(spark, 400), "ra", "dec").withColumn("note", F.expr("repeat('x', 100)"))
    wide = tiles.build_tile_map(tiles.count_cells(df, 5, tiles.row_bytes(df)), 10**9, 5, max_bytes=20_000)
    assert wide.orders[-1] > 0
    held = tiles.assign_tiles(df, wide).groupBy("Norder", "Npix").agg(F.sum(tiles.row_bytes(df)).alias("b"))
    assert held.where("b > 20000 and Norder < 5").count() == 0


def test_a_full_finest_cell_is_named(spark):
    df = add_sky_index(spark.range(50).select(F.lit(10.0).alias("ra"), F.lit(5.0).alias("dec")), "ra", "dec")
    with pytest.raises(CatalogError, match="of order 3 holds 50 rows"):
        tiles.build_tile_map(tiles.count_cells(df, 3), 10, 3, strict=True)


@pytest.mark.parametrize("spread", [0.01, 3e-6])
def test_a_patch_denser_than_the_usual_finest_cell_is_split(spark, tmp_path, spread):
    """More rows than a tile may hold inside one cell of MAX_ORDER; the narrow patch needs orders near the end of the index."""
    rng = np.random.default_rng(4)
    ra = np.concatenate([100.0 + spread * rng.random(300), rng.uniform(0, 360, 100)])
    dec = np.concatenate([20.0 + spread * rng.random(300), rng.uniform(-80, 80, 100)])
    df = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec))], "id long, ra double, dec double")
    path, arcsec = str(tmp_path / "dense"), 900 * spread
    found = write_collection(df, path, "ra", "dec", margin_arcsec=arcsec, max_tile_rows=20)
    table = found.table.toPandas()
    assert max(found.orders) > tiles.MAX_ORDER and found.n_rows == 400 == table.n_rows.sum() and table.n_rows.max() <= 20
    back = read_spatial(spark, path, tiles=True).toPandas()
    assert sorted(back.id) == list(range(400)) and (back.Dir == back.Npix // 10000 * 10000).all()
    assert (back[INDEX_COLUMN].to_numpy() >> (2 * (29 - back.Norder.to_numpy().astype("int64"))) == back.Npix).all()
    assert back.groupby(["Norder", "Npix"]).id.count().sort_index().tolist() == table.set_index(["Norder", "Npix"]).n_rows.sort_index().tolist()
    margin = read_margin(spark, path, tiles=True)
    got = [(r["id"], r["Norder"], r["Npix"]) for r in margin.select("id", "Norder", "Npix").collect()]
    wide, want = math.radians(arcsec / 3600), set()
    for o, pix in zip(table.Norder, table.Npix):
        inner = int(pix) & ((1 << 2 * o) - 1)
        x, y = (sum(((inner >> (2 * i + k)) & 1) << i for i in range(o)) for k in (0, 1))
        away = distance_to_tile(*(np.array(v) for v in (back.ra, back.dec)), *(np.full(400, v) for v in (o, x, y, pix >> 2 * o)))
        own = (back.Norder == o) & (back.Npix == pix)
        want |= {(int(i), int(o), int(pix)) for i in back.id[(away <= wide) & ~own]}
    assert want and len(got) == len(set(got)) and set(got) == want


def test_a_finest_order_of_the_callers_own_is_kept_to(spark, tmp_path):
    df = spark.range(50).select("id", (10 + F.col("id") * 1e-4).alias("ra"), F.lit(5.0).alias("dec"))
    with pytest.raises(CatalogError, match="of order 8 holds 50 rows"):
        write_collection(df, str(tmp_path / "c"), "ra", "dec", max_tile_rows=10, max_order=8)
    one_place = df.withColumn("ra", F.lit(10.0))
    with pytest.raises(CatalogError, match="of order 29 holds 50 rows"):
        write_collection(one_place, str(tmp_path / "c"), "ra", "dec", max_tile_rows=10)
    assert os.listdir(tmp_path) == []


def test_tiles_are_whole_in_their_task_and_one_file(spark, tmp_path):
    """Many input partitions and a small advisory size must not scatter a tile over files."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "1KB")
    try:
        df = sky(spark, 2000).repartition(16)
        write_collection(df, str(tmp_path / "c"), "ra", "dec", margin_arcsec=None, max_tile_rows=100)
    finally:
        spark.conf.set(key, old)
    folders = [d for d, _, files in os.walk(tmp_path / "c") if "/Npix=" in d]
    assert len(folders) > 40
    assert all(sum(f.endswith(".parquet") for f in os.listdir(d)) == 1 for d in folders)


def test_packing_of_tiles_into_tasks(spark):
    df = add_sky_index(sky(spark, 2000), "ra", "dec")
    found = tile_map(df, 150, 5)
    packed, n = found.tasks(6)
    normal = packed[packed.pieces == 1]
    assert n >= 6 and normal["first"].is_monotonic_increasing
    assert normal.groupby("first").n_rows.sum().max() <= 2 * (found.n_rows // 6) + 150


def test_a_coarse_map_is_one_tile_per_face(spark):
    df = add_sky_index(sky(spark, 500), "ra", "dec")
    assert tile_map(df, 10**9, 5).orders == [0]
    with pytest.raises(CatalogError, match="no coordinates"):
        tile_map(add_sky_index(spark.createDataFrame([(None, 1.0), (2.0, 1.0)], "ra double, dec double"), "ra", "dec"), 10, 3)


def brute_force_margin(rows, table, reach):
    """(id, order, pixel) of every row within reach of a foreign tile, and those too close to call."""
    points = vectors(rows.ra.to_numpy(), rows.dec.to_numpy())
    want, unsure = set(), set()
    for o, pix in zip(table.Norder, table.Npix):
        inner = int(pix) & ((1 << 2 * o) - 1)
        x = sum(((inner >> 2 * i) & 1) << i for i in range(o))
        y = sum(((inner >> (2 * i + 1)) & 1) << i for i in range(o))
        s = np.linspace(0, 1, 1501)
        along = np.concatenate([x + s, x + s, x + 0 * s, x + 0 * s + 1]) / 2.0**o
        across = np.concatenate([y + 0 * s, y + 0 * s + 1, y + s, y + s]) / 2.0**o
        edge = face_to_vector(np.full(along.shape, pix >> 2 * o), along, across)
        centre = edge.mean(axis=1) / np.linalg.norm(edge.mean(axis=1))
        radius = np.arccos(np.clip(centre @ edge, -1, 1)).max()
        for i in np.where(np.arccos(np.clip(centre @ points, -1, 1)) <= radius + reach + 0.01)[0]:
            if (rows.Norder[i], rows.Npix[i]) == (o, pix):
                continue
            distance = 2 * np.arcsin(np.sqrt(((edge - points[:, [i]]) ** 2).sum(axis=0)).min() / 2)
            key = (int(rows.id[i]), int(o), int(pix))
            if abs(distance - reach) < 2e-4 * max(1.0, reach * 100):
                unsure.add(key)
            elif distance <= reach:
                want.add(key)
    return want, unsure


@pytest.mark.parametrize("arcsec", [120.0, 3600.0, 5 * 3600.0])
def test_margin_equals_brute_force(spark, arcsec):
    """Adaptive tiles, some smaller than the widest threshold; poles and face borders included."""
    df = add_sky_index(sky(spark, 1500, seed=2), "ra", "dec")
    found = tile_map(df, 150, 5)
    stored = as_table(tiles.assign_tiles(df, found), "assigned")
    got = [(r["id"], r["Norder"], r["Npix"]) for r in tiles.margin_rows(stored, found, "ra", "dec", arcsec).collect()]
    assert len(got) == len(set(got))
    want, unsure = brute_force_margin(stored.toPandas(), found.table.toPandas(), math.radians(arcsec / 3600))
    assert want and set(got) - unsure == want - unsure


def test_distance_is_exact_at_a_corner():
    ra, dec = np.array([45.0]), np.array([89.0])
    zero = np.array([0])
    # Face 2 touches face 0 only at the pole, one degree away.
    assert distance_to_tile(ra, dec, zero, zero, zero, np.array([2]))[0] == pytest.approx(math.radians(1.0), rel=1e-9)


@pytest.mark.parametrize("order, reach", [(0, 0.2), (6, math.radians(0.5)), (12, math.radians(0.5)), (14, math.radians(5 / 3600)), (29, 1e-9)])
def test_reach_is_told_by_bounds_for_most_pairs(monkeypatch, order, reach):
    rng = np.random.default_rng(order)
    n, some, side = 4000, 30, 2.0**-order
    at = np.stack([np.full(some, order), *rng.integers(0, 1 << order, (2, some)), rng.integers(0, 12, some)])
    at[1:3, :6], at[1, 6:12] = (1 << order) - 1, 0
    at = at[:, rng.integers(0, some, n)]
    point = face_to_vector(at[3], (at[1] + 0.5) * side, (at[2] + 0.5) * side)
    way = rng.normal(size=(3, n))
    point = point + way / np.linalg.norm(way, axis=0) * rng.random(n) * (1.2 * side + 1.3 * reach)
    ra, dec = np.degrees(np.arctan2(point[1], point[0])), np.degrees(np.arcsin(point[2] / np.linalg.norm(point, axis=0)))
    want, measured = distance_to_tile(ra, dec, *at) <= reach, []
    monkeypatch.setattr(tile_distance, "distance_to_tile", lambda *a: (measured.append(len(a[0])), distance_to_tile(*a))[1])
    got = tile_distance.within_reach(ra, dec, *at, reach)
    assert (got == want).all() and 0 < want.sum() < n
    assert sum(measured) < n / 10 or reach < 1e-6
    assert len(tile_distance.within_reach(*(v[:0] for v in (ra, dec, *at)), reach)) == 0


def test_largest_stretch_is_below_the_bound():
    rng = np.random.default_rng(0)
    n, h = 200_000, 1e-6
    face, x, y = rng.integers(0, 12, n), rng.random(n) * 0.999, rng.random(n) * 0.999
    for right, up in ((h, 0), (0, h)):
        step = face_to_vector(face, x + right, y + up) - face_to_vector(face, x, y)
        assert (np.sqrt((step**2).sum(axis=0)) / h).max() < tile_distance.MAX_STRETCH


def test_margins_of_neighbouring_tiles_are_dealt_out(spark):
    """Small tiles side by side in a dense patch have the most margin rows; no task may hold all of theirs."""
    rng = np.random.default_rng(3)
    ra = np.concatenate([100.0 + rng.random(600), rng.uniform(0, 360, 3000)])
    dec = np.concatenate([20.0 + rng.random(600), np.degrees(np.arcsin(rng.uniform(-1, 1, 3000)))])
    df = spark.createDataFrame([(float(a), float(d)) for a, d in zip(ra, dec)], "ra double, dec double")
    indexed = add_sky_index(df, "ra", "dec")
    found = tile_map(indexed, 20, 10)
    rows = tiles.margin_rows(as_table(tiles.assign_tiles(indexed, found), "dense"), found, "ra", "dec", 1800.0)
    together = tiles.cluster_tiles(rows, found, counted=False).withColumn("task", F.spark_partition_id()).toPandas()
    assert (together.groupby(["Norder", "Npix"]).task.nunique() == 1).all()
    per_task = together.groupby("task").size()
    assert per_task.max() < 2 * per_task.mean()


def test_margin_threshold_must_make_sense(spark):
    df = add_sky_index(sky(spark, 50), "ra", "dec")
    found = tile_map(df, 1000, 2)
    assigned = tiles.assign_tiles(df, found)
    for bad in (0, -1.0, 60 * 3600.0):
        with pytest.raises(CatalogError):
            tiles.margin_rows(assigned, found, "ra", "dec", bad)


def test_collection_round_trip(spark, tmp_path):
    df = sky(spark, 800).withColumn("z", F.col("id") * 0.001)
    path = str(tmp_path / "survey")
    found = write_collection(df, path, "ra", "dec", margin_arcsec=600.0, max_tile_rows=300, sort_column="z")
    back = read_spatial(spark, path, tiles=True)
    assert back.count() == df.count()
    assert set(back.columns) == {"id", "ra", "dec", "z", INDEX_COLUMN, "Norder", "Dir", "Npix"}
    expected = tiles.assign_tiles(add_sky_index(df, "ra", "dec"), found)
    assert back.select("id", "Norder", "Npix").exceptAll(expected.select("id", "Norder", "Npix")).count() == 0
    margin = read_margin(spark, path, tiles=True)
    stored = as_table(expected, "stored")
    fresh = tiles.margin_rows(stored, found, "ra", "dec", 600.0)
    key = ["id", "Norder", "Npix"]
    assert {tuple(r) for r in margin.select(*key).collect()} == {tuple(r) for r in fresh.select(*key).collect()}
    assert read_spatial(spark, path, ["z", "id"]).columns == ["z", "id"]
    facts = read_text(spark, f"{path}/survey/hats.properties")
    assert f"hats_nrows={df.count()}" in facts and "hats_cols_sort=z" in facts
    info = read_text(spark, f"{path}/survey/partition_info.csv").splitlines()
    assert info[0] == "Norder,Npix" and len(info) == found.n_tiles + 1
    with pytest.raises(CatalogError, match="already exists"):
        write_collection(df, path, "ra", "dec")


def test_rows_are_sorted_inside_their_tile(spark):
    df = add_sky_index(sky(spark, 800).withColumn("k", F.hash("id")), "ra", "dec")
    found = tile_map(df, 400, 4)
    grouped = tiles.cluster_tiles(tiles.assign_tiles(df, found), found, "k")
    part = grouped.withColumn("p", F.spark_partition_id()).toPandas()
    for _, rows in part.groupby(["p", "Norder", "Npix"], sort=False):
        assert rows.k.is_monotonic_increasing


def test_a_hot_tile_is_split_over_tasks(spark, tmp_path):
    """Most rows on one spot: the rebalanced write must not leave them to one task."""
    size, key = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    old = {k: spark.conf.get(k) for k in (size, key)}
    spark.conf.set(size, "64KB")
    spark.conf.set(key, "16KB")
    try:
        df = spark.range(0, 60_000, 1, 8).select("id", F.when(F.col("id") % 3 < 2, F.lit(10.0)).otherwise(F.col("id") % 360.0).alias("ra"), F.lit(5.0).alias("dec"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        indexed = add_sky_index(df, "ra", "dec")
        found = tile_map(indexed, 1000, 3)
        grouped = tiles.cluster_tiles(tiles.assign_tiles(indexed, found), found)
        grouped.withColumn("task", F.spark_partition_id()).write.parquet(str(tmp_path / "hot"))
        written = spark.read.parquet(str(tmp_path / "hot"))
        assert written.count() == 60_000
        assert written.where(F.col("ra") == 10.0).select("task").distinct().count() > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_single_file_leaves_and_default_collection(spark, tmp_path):
    """Layout of other writers: one file per tile, its number only in the file name."""
    leaf = tmp_path / "c" / "catalog" / "dataset" / "Norder=0" / "Dir=0"
    leaf.mkdir(parents=True)
    for npix in (2, 8):
        spark.createDataFrame([(npix * 10, 1.0)], "id long, z double").toPandas().to_parquet(leaf / f"Npix={npix}.parquet")
    path = str(tmp_path / "c")
    write_text(spark, f"{path}/catalog/hats.properties", "#HATS catalog\nhats_npix_suffix=.parquet\nbad line\n")
    assert CollectionLayout.of(spark, path).primary == "catalog"
    rows = {tuple(r) for r in read_spatial(spark, path, ["id"], tiles=True).collect()}
    assert rows == {(20, 0, 0, 2), (80, 0, 0, 8)}
    assert read_margin(spark, path) is None


def test_margin_choice(spark, tmp_path):
    path = str(tmp_path / "c")
    for name, threshold in (("m10", "10.0"), ("m5", "5"), ("m7", "7.5"), ("broken", "x")):
        write_text(spark, f"{path}/{name}/hats.properties", f"dataproduct_type=margin\nhats_margin_threshold={threshold}\n")
    named = "hats_primary_table_url=catalog\nall_margins=m10 m5, m7 broken gone\n"
    write_text(spark, f"{path}/collection.properties", named)
    chosen = lambda *t: getattr(CollectionLayout.of(spark, path).margin(*t), "folder", None)
    assert chosen() == f"{path}/m5"
    assert chosen(10.0) == f"{path}/m10"
    assert chosen(11.0) is None
    write_text(spark, f"{path}/collection.properties", named + "default_margin=m7\n")
    assert chosen() == f"{path}/m7"
    write_text(spark, f"{path}/collection.properties", "default_margin=m7\n")
    assert chosen() == f"{path}/m7" and chosen(5.0) is None


def test_a_margin_can_be_added(spark, tmp_path):
    path = str(tmp_path / "c")
    found = write_collection(sky(spark, 300), path, "ra", "dec", margin_arcsec=60.0, max_tile_rows=100)
    assert add_margin(spark, path, 1800.0) == "c_1800arcs"
    with pytest.raises(CatalogError, match="already"):
        add_margin(spark, path, 1800.0)
    stored = as_table(tiles.assign_tiles(add_sky_index(sky(spark, 300), "ra", "dec"), found), "stored")
    want = tiles.margin_rows(stored, found, "ra", "dec", 1800.0)
    got = read_margin(spark, path, 1800.0, tiles=True)
    key = ["id", "Norder", "Npix"]
    assert {tuple(r) for r in got.select(*key).collect()} == {tuple(r) for r in want.select(*key).collect()}
    assert CollectionLayout.of(spark, path).margins == ["c_60arcs", "c_1800arcs"]
    assert CollectionLayout.of(spark, path).margin().folder == f"{path}/c_60arcs"


def test_a_failed_rewrite_keeps_the_collection(spark, tmp_path):
    path = str(tmp_path / "c")
    good = spark.createDataFrame([(1, 45.0, 40.0)], "id long, ra double, dec double")
    write_collection(good, path, "ra", "dec")
    with pytest.raises(CatalogError):
        write_collection(good.withColumn("ra", F.lit(400.0)), path, "ra", "dec", overwrite=True)
    assert [r["id"] for r in read_spatial(spark, path, ["id"]).collect()] == [1]
    write_collection(read_spatial(spark, path).withColumn("id", F.lit(2)), path, "ra", "dec", overwrite=True)
    assert [r["id"] for r in read_spatial(spark, path, ["id"]).collect()] == [2]
    assert sorted(os.listdir(tmp_path)) == ["c"]


def test_empty_margin_reads_back_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, 45.0, 40.0)], "id long, ra double, dec double")
    path = str(tmp_path / "one")
    write_collection(df, path, "ra", "dec")
    margin = read_margin(spark, path)
    assert margin.count() == 0 and margin.columns == ["id", "ra", "dec", INDEX_COLUMN]


def test_checks_when_the_filter_is_folded_away(spark, tmp_path):
    """A result the optimizer proves empty never runs the scan; validation must still happen."""
    spec = {
        "coordinates": {"ra_column": "ra", "dec_column": "dec"},
        "redshift": {"column": "z", "filters": [{"op": ">", "value": 5}]},
        "transformations": [{"type": "add_constant_column", "name": "z", "value": 0.5}],
    }
    good = spark.createDataFrame([(1.0, 2.0)], "ra double, dec double")
    curate_to(good, spec, str(tmp_path / "good"))
    bad = spark.createDataFrame([(400.0, 2.0)], "ra double, dec double")
    with pytest.raises(CatalogError, match="RA column"):
        curate_to(bad, spec, str(tmp_path / "bad"))
    with pytest.raises(CatalogError):
        curate_to_collection(good, spec, str(tmp_path / "sky"))

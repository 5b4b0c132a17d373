import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

import skyloom
from checks.fits_files import table_bytes
from skyloom import CatalogError, prepare, read_catalog, read_csv, read_fits, read_footprint, read_whitespace
from skyloom.operators.union import common_type, union_outer, union_strict
from skyloom.sinks.parquet import output_layout, write_parquet
from skyloom.sources.fits import rows_per_partition

# The few golden rows below must equal those of the tool this library follows.


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def test_csv_types_and_missing_tokens(spark, write_file):
    text = 'id,z,flag,name,none,sfx,s p\n1,0.5,True,"a, ""b""",,1d,x\n2,NA,false,nan,,2f,y\n 3 ,inf,,c,NULL,3d,None\n'
    df = read_csv(spark, write_file("a.csv", text))
    assert types(df) == {
        "id": "bigint",
        "z": "double",
        "flag": "boolean",
        "name": "string",
        "none": "double",
        "sfx": "string",
        "s p": "string",
    }
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows[0] == (1, 0.5, True, 'a, "b"', None, "1d", "x")
    assert rows[1] == (2, None, False, None, None, "2f", "y")
    assert rows[2][:4] == (3, float("inf"), None, "c")


def test_csv_gzip_and_asked_types(spark, tmp_path):
    path = str(tmp_path / "a.csv.gz")
    with gzip.open(path, "wt") as handle:
        handle.write("id,z\n1,2\n")
    df = read_catalog(spark, path)
    assert types(df) == {"id": "bigint", "z": "bigint"}
    assert types(read_csv(spark, path, {"z": "float32"}))["z"] == "float"


def test_whitespace(spark, write_file):
    text = "# header\n 1  10.5   abc # note\n\n2\t11   def\n3 12.25\n"
    path = write_file("a.dat", text)
    df = read_whitespace(spark, path, ["id", "ra", "name"])
    assert types(df) == {"id": "bigint", "ra": "double", "name": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 10.5, "abc"), (2, 11.0, "def"), (3, 12.25, None)]
    assert read_catalog(spark, write_file("b.txt", text), ["id", "ra", "name"]).count() == 3
    with pytest.raises(CatalogError, match="its 3 columns"):
        read_whitespace(spark, path, None)
    with pytest.raises(CatalogError, match="column_names 2"):
        read_whitespace(spark, path, ["a", "b"])


def test_txt_without_names_is_csv(spark, write_file):
    assert read_catalog(spark, write_file("a.txt", "a,b\n1,2\n")).columns == ["a", "b"]


def test_footprints(spark, write_file):
    region = write_file("r.csv", "region_id,ring_type,vertex_id,ra_deg,dec_deg\n0,exterior,0,10,-1\n0,exterior,1,x,-1\n")
    limit = write_file("l.csv", "ra_center,dec_limit\n10,20\n11,21\n")
    assert [r["ra_deg"] for r in read_footprint(spark, region).orderBy("vertex_id").collect()] == [10.0, None]
    assert types(read_footprint(spark, limit, "declination_limit")) == {"ra_center": "double", "dec_limit": "double"}
    with pytest.raises(CatalogError, match="does not match"):
        read_footprint(spark, limit, "region_vertices")
    with pytest.raises(CatalogError, match="unsupported columns"):
        read_footprint(spark, write_file("b.csv", "ra,dec\n1,2\n"))


def test_fits_chunk_rule():
    assert rows_per_partition(200_000, 3452, 100 * 1024 * 1024) == 30_375
    assert rows_per_partition(200_000, 10, 100 * 1024 * 1024) == 200_000
    assert rows_per_partition(200_000, 10**9, 100) == 1


def fits_columns(n):
    ids = np.arange(n)
    return [
        ("ID", "K", ids.astype(">i8")),
        ("SHORT", "I", (ids % 100).astype(">i2")),
        ("BYTE", "B", (ids % 200).astype("u1")),
        ("UNSIGNED", "J", (ids - 2**31).astype(">i4")),
        ("SCALED", "I", ids.astype(">i2")),
        ("FLAG", "L", np.where(ids % 2 == 0, b"T", b"F").astype("S1")),
        ("NAME", "6A", np.array([f"n{i} " for i in ids], "S6")),
        ("RA", "D", (ids * 0.5).astype(">f8")),
        ("MAG", "E", (ids * 0.25).astype(">f4")),
        ("FLUX", "3E", np.stack([ids, ids + 1, ids + 2], axis=1).astype(">f4")),
        ("CPLX", "M", np.stack([ids, -ids], axis=1).astype(">f8")),
    ]


def test_fits(spark, tmp_path):
    extra = [("TZERO4", 2147483648), ("TSCAL5", 0.5), ("TZERO5", 1.0)]
    path = tmp_path / "a.fits"
    path.write_bytes(table_bytes(fits_columns(25), extra))
    df = read_fits(spark, str(path), chunk_rows=10)
    assert types(df) == {
        "ID": "bigint",
        "SHORT": "smallint",
        "BYTE": "smallint",
        "UNSIGNED": "bigint",
        "SCALED": "double",
        "FLAG": "boolean",
        "NAME": "string",
        "RA": "double",
        "MAG": "float",
        "FLUX": "array<float>",
        "CPLX": "array<double>",
    }
    assert df.rdd.getNumPartitions() == 3
    rows = df.orderBy("ID").collect()
    assert len(rows) == 25
    assert tuple(rows[7]) == (7, 7, 7, 7, 4.5, False, "n7", 3.5, 1.75, [7.0, 8.0, 9.0], [7.0, -7.0])
    assert read_fits(spark, str(path), columns=["RA", "ID"]).columns == ["RA", "ID"]
    with gzip.open(tmp_path / "b.fits.gz", "wb") as handle:
        handle.write(path.read_bytes())
    assert read_catalog(spark, str(tmp_path / "b.fits.gz")).count() == 25


def test_fits_variable_length(spark, tmp_path):
    lists, words = [[1.5], [], [2.0, 3.0, 4.0]], [b"ab", b"", b"xyz"]
    heap, floats, texts = b"", [], []
    for values, word in zip(lists, words):
        floats.append((len(values), len(heap)))
        heap += np.array(values, ">f4").tobytes()
        texts.append((len(word), len(heap)))
        heap += word
    columns = [
        ("ID", "J", np.arange(3).astype(">i4")),
        ("FLUX", "1PE(3)", np.array(floats, ">i4")),
        ("WORD", "QA", np.array(texts, ">i8")),
    ]
    path = tmp_path / "v.fits"
    path.write_bytes(table_bytes(columns, heap=heap))
    df = read_fits(spark, str(path), chunk_rows=2)
    assert types(df) == {"ID": "int", "FLUX": "array<float>", "WORD": "string"}
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [(0, [1.5], "ab"), (1, [], ""), (2, [2.0, 3.0, 4.0], "xyz")]


def test_empty_fits(spark, tmp_path):
    path = tmp_path / "a.fits"
    path.write_bytes(table_bytes(fits_columns(0)))
    df = read_catalog(spark, str(path))
    assert df.count() == 0 and "RA" in df.columns


def test_union(spark):
    a = spark.createDataFrame([(1, 0.1)], "object_id long, z double")
    b = spark.createDataFrame([(2, 0.2, 3)], "object_id int, z double, quality long")
    c = spark.createDataFrame([("x", 5)], "object_id string, z int")
    out = union_outer([a, b])
    assert out.columns == ["object_id", "z", "quality"]
    assert [r["quality"] for r in out.orderBy("object_id").collect()] == [None, 3]
    assert types(out) == {"object_id": "bigint", "z": "double", "quality": "bigint"}
    assert {r["object_id"] for r in union_strict([a, c]).collect()} == {"1", "x"}
    with pytest.raises(CatalogError, match="same schema"):
        union_strict({"a": a, "b": b})


def test_output_modes():
    assert [output_layout(m) for m in ("auto", "partitioned", "single")] == ["partitioned", "partitioned", "single"]
    with pytest.raises(CatalogError, match="many"):
        output_layout("many")


def test_failed_and_in_place_overwrites_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    spec = {"coordinates": {"ra_column": "ra", "dec_column": "dec"}, "redshift": {"column": "z"}}
    good = spark.createDataFrame([(1.0, 2.0, 0.5), (3.0, 4.0, 0.6)], "ra double, dec double, z double")
    skyloom.curate_to(good, spec, path)
    with pytest.raises(CatalogError, match="RA column"):
        skyloom.curate_to(good.withColumn("ra", F.lit(400.0)), spec, path, overwrite=True)
    assert spark.read.parquet(path).count() == 2
    few = {**spec, "redshift": {"column": "z", "filters": [{"op": ">", "value": 0.55}]}}
    skyloom.curate_to(spark.read.parquet(path), few, path, overwrite=True)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(CatalogError, match="holds the input"):
        skyloom.curate_to(spark.read.parquet(path), few, str(tmp_path), overwrite=True, sources=[path])
    with pytest.raises(CatalogError, match="holds the input"):
        prepare(spark, [path], path, overwrite=True, output_format="hats", ra="ra", dec="dec")
    assert sorted(os.listdir(tmp_path)) == ["out"]


def test_target_size_rebalances_what_is_written(spark, tmp_path):
    df = spark.range(0, 40_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"))
    for size, files in ((10**9, 1), (400_000, 4)):
        write_parquet(df, str(tmp_path / str(size)), target_partition_bytes=size)
        written = [f for f in os.listdir(tmp_path / str(size)) if f.endswith(".parquet")]
        assert len(written) == 1 if files == 1 else len(written) >= files
        assert spark.read.parquet(str(tmp_path / str(size))).count() == 40_000


def test_a_small_zipped_input_is_written_by_its_scan(spark, tmp_path):
    path = str(tmp_path / "a.csv.gz")
    with gzip.open(path, "wt") as handle:
        handle.write("id,z\n" + "".join(f"{i},0.5\n" for i in range(100)))
    out = prepare(spark, path, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / "_curation_manifest.json").read_text())["output_mode"] == "partitioned"
    assert spark.read.parquet(out).count() == 100


def test_write_keeps_binary_and_lists(spark, tmp_path):
    df = spark.createDataFrame([(1, b"x", [1.0, 2.0, 3.0])], "object_id long, label binary, pdf array<float>")
    path = str(tmp_path / "out")
    write_parquet(df, path, "single")
    assert types(spark.read.parquet(path)) == types(df)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 1
    with pytest.raises(CatalogError, match="already exists"):
        write_parquet(df, path)
    write_parquet(df, path, overwrite=True, target_partition_bytes=1 << 20)


def test_prepare(spark, write_file, tmp_path):
    one = write_file("one.csv", "object_id,z\n1,0.1\n")
    two = write_file("two.csv", "object_id,z,quality\n2,0.2,3\n")
    out = prepare(spark, [one, two], str(tmp_path / "out"), schema_policy="union")
    rows = [tuple(r) for r in spark.read.parquet(out).orderBy("object_id").collect()]
    assert rows == [(1, 0.1, None), (2, 0.2, 3)]
    facts = json.loads((tmp_path / "out" / "_curation_manifest.json").read_text())
    assert facts["output_mode"] == "partitioned" and facts["source_format"] == "csv"
    assert prepare(spark, out, "unused") == out
    with pytest.raises(CatalogError, match="same schema"):
        prepare(spark, [one, two], str(tmp_path / "strict"))
    with pytest.raises(CatalogError, match="different formats"):
        prepare(spark, [one, write_file("c.dat", "1 2\n")], str(tmp_path / "mixed"), column_names=["a", "b"])
    single = prepare(spark, one, str(tmp_path / "single"), output_mode="single")
    assert json.loads((tmp_path / "single" / "_curation_manifest.json").read_text())["output_mode"] == "single"
    assert spark.read.parquet(single).count() == 1


@pytest.mark.parametrize("row", ["360.0,0.0", "-1.0,0.0", "10.0,90.0", "10.0,-90.0", "ten,0.0", ","])
def test_prepare_spatial_refuses_bad_coordinates(spark, write_file, tmp_path, row):
    path = write_file("a.csv", f"object_id,ra,dec\n1,{row}\n")
    with pytest.raises(CatalogError):
        prepare(spark, path, str(tmp_path / "sky"), output_format="hats", ra="ra", dec="dec")


def test_prepare_spatial(spark, write_file, tmp_path):
    path = write_file("a.csv", "object_id,ra,dec,z\n1,10.0,-1.0,0.1\n2,11.0,-1.1,0.2\n")
    out = prepare(spark, path, str(tmp_path / "sky"), output_format="hats", ra="ra", dec="dec", sort_column="z")
    assert read_catalog(spark, out).count() == 2
    with pytest.raises(CatalogError, match="prepared already"):
        prepare(spark, out, str(tmp_path / "again"))


def test_names_that_differ_by_case_need_the_setting(spark, write_file):
    path = write_file("case.csv", "Z,id,z\n0.1,1,0.2\n")
    with pytest.raises(CatalogError, match="caseSensitive"):
        read_csv(spark, path)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert [tuple(r) for r in read_csv(spark, path).collect()] == [(0.1, 1, 0.2)]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert read_csv(spark, write_file("like.csv", "a0,b1,a2\n1,2,3\n")).columns == ["a0", "b1", "a2"]


def test_quotes_hold_a_blank_field_together(spark, write_file):
    path = write_file("q.dat", '1 "NGC 12" 3.0 # note\n2 "x # y" 4.5\n# all of it\n\n3 z 1\n')
    rows = read_whitespace(spark, path, ["id", "name", "z"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "NGC 12", 3.0), (2, "x # y", 4.5), (3, "z", 1.0)]


def test_common_types_hold_every_value():
    t = lambda *names: common_type([T._parse_datatype_string(n) for n in names]).simpleString()
    assert t("int", "bigint") == "bigint" and t("bigint", "decimal(10,4)") == "decimal(23,4)"
    assert t("decimal(38,10)", "bigint") == "decimal(38,10)" and t("decimal(38,0)", "decimal(38,38)") == "string"
    assert t("bigint", "double") == "double" and t("bigint", "boolean") == "string"


def test_parquet_folders_of_differing_files(spark, tmp_path):
    path = str(tmp_path / "mixed")
    spark.createDataFrame([(1, 2.0)], "id long, ra double").write.parquet(path)
    spark.createDataFrame([(2, 3.0, 4.0)], "id long, ra double, dec double").write.mode("append").parquet(path)
    got = skyloom.read_parquet(spark, path).select("id", "ra", "dec").orderBy("id")
    assert [tuple(r) for r in got.collect()] == [(1, 2.0, None), (2, 3.0, 4.0)]
    with pytest.raises(CatalogError, match="same schema"):
        skyloom.read_sources(spark, [path])
    assert set(skyloom.read_sources(spark, [path], schema_policy="union").columns) == {"id", "ra", "dec"}


@pytest.mark.parametrize("wider", ["a", "b"])
def test_strict_compares_every_file_whichever_comes_first(spark, tmp_path, wider):
    import pyarrow as pa
    from pyarrow import parquet

    (tmp_path / "mixed").mkdir()
    for name in "ab":
        columns = {"id": [1], "ra": [2.0]} | ({"dec": [4.0]} if name == wider else {})
        parquet.write_table(pa.table(columns), tmp_path / "mixed" / f"{name}.parquet")
    for paths in ([str(tmp_path / "mixed")], [str(tmp_path / "mixed" / f"{n}.parquet") for n in "ab"]):
        with pytest.raises(CatalogError, match="same schema"):
            skyloom.read_sources(spark, paths)
        got = skyloom.read_sources(spark, paths, schema_policy="union").collect()
        assert sorted(r.dec for r in got if r.dec is not None) == [4.0] and len(got) == 2


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    def jobs(label, action):
        spark.sparkContext.setJobGroup(label, label)
        try:
            action()
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(label))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    for i in range(200):
        (tmp_path / f"{i:03}.csv").write_text("id,ra\n1,2.5\n" if i % 2 else '"id",ra,"z,z"\n1,2.5,3\n')
    paths = [str(tmp_path / f"{i:03}.csv") for i in range(200)]
    read = lambda n: skyloom.read_sources(spark, paths[:n], schema_policy="union")
    few, some, many = (jobs(f"of {n}", lambda n=n: read(n)) for n in (12, 80, 200))
    assert few <= some == many <= 12  # Spark itself lists more than 32 paths by a job
    assert read(200).columns == ["id", "ra", "z,z"] and read(200).count() == 200
    with pytest.raises(CatalogError, match="same schema"):
        skyloom.read_sources(spark, paths)

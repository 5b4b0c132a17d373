import math

import pytest

from skyloom import CatalogError, CurateSpec, curate, curate_to, curate_to_collection, read_csv, read_spatial
from skyloom.operators.transforms import apply_transformations, zero_degree_rows
from skyloom.operators.validate import flag_redshift, required_inputs
from skyloom.session import path_exists

BASE = "object_id,ra,dec,z,quality,extra\n1,10.0,-1.0,0.1,3,drop\n"

# The small inputs and the results of the golden cases below must equal those of the tool this library follows.


def spec(z="z", **more):
    redshift = {"column": z, **more.pop("redshift", {})}
    return {"coordinates": {"ra_column": "ra", "dec_column": "dec"}, "redshift": redshift, **more}


def redshifts(spark, values, column="z"):
    rows = [(i, 10.0, -1.0, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"object_id long, ra double, dec double, {column} double")


def column(df, name, key="object_id"):
    return [r[name] for r in df.orderBy(key).collect()]


def test_constant_cast_and_selection(spark, write_file):
    df = read_csv(spark, write_file("a.csv", BASE))
    out = curate(
        df,
        spec(
            column_selection=["object_id", "ra", "dec", "z", "quality"],
            transformations=[
                {"type": "add_constant_column", "name": "survey_name", "value": "SAMPLE"},
                {"type": "cast", "column": "quality", "dtype": "float64"},
            ],
        ),
    )
    assert out.columns == ["object_id", "ra", "dec", "z", "quality", "survey_name"]
    assert out.schema["quality"].dataType.simpleString() == "double"
    assert out.first().asDict()["survey_name"] == "SAMPLE"


@pytest.mark.parametrize(
    ("selection", "position", "expected"),
    [
        (["object_id", "ra", "dec", "z"], "first", ["survey_name", "object_id", "ra", "dec", "z"]),
        ([], "last", ["object_id", "ra", "dec", "z", "quality", "extra", "survey_name"]),
    ],
)
def test_column_order(spark, write_file, selection, position, expected):
    df = read_csv(spark, write_file("a.csv", BASE))
    made = [{"type": "add_constant_column", "name": "survey_name", "value": "X"}]
    out = curate(df, spec(column_selection=selection, transformations=made, generated_columns_position=position))
    assert out.columns == expected


def test_sign_absolute_replace_and_dms(spark, write_file):
    df = read_csv(spark, write_file("a.csv", "dec_raw,dec_min,dec_sec,imag,file\n-4,47,41.6,-1,-1\n"))
    out, made = apply_transformations(
        df,
        [
            {"type": "signed_value_sign", "input_column": "dec_raw", "output_column": "dec_sign"},
            {"type": "absolute_value", "input_column": "dec_raw", "output_column": "dec_degree", "dtype": "int64"},
            {
                "type": "dec_dms_to_degrees",
                "output_column": "dec",
                "degrees": "dec_raw",
                "arcminutes": "dec_min",
                "arcseconds": "dec_sec",
            },
            {"type": "replace_values", "column": "imag", "replacements": [{"from": -1, "to": None}]},
            {
                "type": "replace_values",
                "column": "file",
                "replacements": [{"from": -1, "to": None}, {"from": "-1", "to": None}],
            },
        ],
    )
    row = out.first()
    assert (row["dec_sign"], row["dec_degree"]) == ("-", 4)
    assert row["dec"] == pytest.approx(-4.794888888888889, abs=1e-14)
    assert row["imag"] is None and row["file"] is None
    assert made == ["dec_sign", "dec_degree", "dec"]


def test_zero_degrees_lose_their_minutes_and_are_counted(spark):
    df = spark.createDataFrame([(0.0, 30.0, 0.0), (0.0, 0.0, 0.0), (1.0, 30.0, 0.0)], "d double, m double, s double")
    one = {"type": "dec_dms_to_degrees", "output_column": "o", "degrees": "d", "arcminutes": "m", "arcseconds": "s"}
    assert sorted(r["o"] for r in apply_transformations(df, [one])[0].collect()) == [0.0, 0.0, 1.5]
    assert zero_degree_rows(df, one).first()[0] == 1


def test_velocity(spark):
    df = spark.createDataFrame([(299792.458, 299.792458)], "V double, EV double")
    one = {"type": "velocity_to_redshift", "velocity_column": "V", "velocity_error_column": "EV"}
    out, made = apply_transformations(df, [one])
    assert made == ["redshift", "redshift_err"]
    assert (out.first()["redshift"], out.first()["redshift_err"]) == (1.0, pytest.approx(0.001))


def test_fail_policy(spark):
    with pytest.raises(CatalogError, match="outside the required range"):
        curate(redshifts(spark, [99.0]), spec())
    with pytest.raises(CatalogError, match="outside the required range"):
        curate(redshifts(spark, [None]), spec())


@pytest.mark.parametrize(
    ("values", "redshift", "expected"),
    [
        ([0.1, 99.0, -0.2], {"invalid_policy": "flag"}, [0.1, -1.0, -1.0]),
        ([0.1, 99.0, -0.2], {"invalid_policy": "keep"}, [0.1, 99.0, -0.2]),
        ([0.1, math.nan, None], {"invalid_policy": "flag", "invalid_value": -5}, [0.1, -5.0, -5.0]),
        ([-0.005], {}, [-0.005]),
        ([0.1, -0.005, 0.0], {"invalid_policy": "flag", "allow_blueshifts": False}, [0.1, -1.0, -1.0]),
    ],
)
def test_policies(spark, values, redshift, expected):
    assert column(curate(redshifts(spark, values), spec(redshift=redshift)), "z") == expected


def test_no_blueshift_fails_with_its_own_range(spark):
    with pytest.raises(CatalogError, match=r"\(0\.0, 20\.0\)"):
        curate(redshifts(spark, [-0.005]), spec(redshift={"allow_blueshifts": False}))


@pytest.mark.parametrize(
    ("values", "redshift", "expected"),
    [
        ([0.5, 1.6, 2.0, 9.0], {"filters": [{"op": ">", "value": 1.6}, {"op": "<", "value": 9}]}, [2.0]),
        ([0.5, 99.0, -0.2], {"invalid_policy": "flag", "filters": [{"operator": "<", "value": 9}]}, [0.5]),
        ([0.5, math.nan, None], {"invalid_policy": "keep", "filters": [{"op": "!=", "value": 3}]}, [0.5]),
        ([0.5, 0.7], {"filters": [{"op": "==", "value": 0.7}]}, [0.7]),
    ],
)
def test_filters(spark, values, redshift, expected):
    assert column(curate(redshifts(spark, values), spec(redshift=redshift)), "z") == expected


def coalesce(**more):
    return {"type": "coalesce_redshift", "output_column": "z_final", "columns": ["z_spec", "z_phot"], **more}


def pairs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "object_id long, z_spec double, z_phot double")


def test_coalesce_and_labels(spark):
    df = pairs(spark, [(0.10, 0.20), (99.0, 0.30), (-0.2, 99.0), (None, math.nan)])
    one = coalesce(label_column="z_source", labels=["s", "p"], invalid_label="none")
    out, made = apply_transformations(df, [one])
    assert column(out, "z_final") == [0.1, 0.3, -1.0, -1.0]
    assert column(out, "z_source") == ["s", "p", "none", "none"]
    assert made == ["z_final", "z_source"]


def test_coalesce_default_label_and_inherited_blueshift_rule(spark):
    df = pairs(spark, [(99.0, 0.20)])
    assert column(apply_transformations(df, [coalesce(label_column="z_source")])[0], "z_source") == ["z_phot"]
    df = pairs(spark, [(-0.005, 0.20), (-0.004, -0.003)])
    assert column(apply_transformations(df, [coalesce()], allow_blueshifts=False)[0], "z_final") == [0.2, -1.0]
    kept = coalesce(allow_blueshifts=True)
    assert column(apply_transformations(df, [kept], allow_blueshifts=False)[0], "z_final") == [-0.005, -0.004]


def test_coalesce_when_the_invalid_value_is_itself_valid(spark):
    """A candidate equal to the sentinel counts as unset; the last one names the row if valid."""
    df = pairs(spark, [(0.5, 0.7), (0.5, 99.0), (99.0, 0.5)])
    out = apply_transformations(df, [coalesce(invalid_value=0.5, label_column="src", labels=["s", "p"])])[0]
    assert column(out, "z_final") == [0.7, 0.5, 0.5]
    assert column(out, "src") == ["p", "invalid", "p"]


@pytest.mark.parametrize(
    ("ra", "dec", "expected"),
    [
        ("12:30:00", "-00:30:00", (187.5, -0.5)),
        ("1h30m0s", "+10d30m", (22.5, 10.5)),
        ("24 00 00", "90 0 0", (0.0, 90.0)),
        ("10d", "-5.5", (10.0, -5.5)),
        ("1.5", "0", (22.5, 0.0)),
        (None, None, (None, None)),
    ],
)
def test_sky_coordinates_from_text(spark, ra, dec, expected):
    df = spark.createDataFrame([(ra, dec)], "r string, d string")
    one = {
        "type": "skycoord_to_degrees",
        "ra_column": "r",
        "dec_column": "d",
        "output_ra_column": "ra",
        "output_dec_column": "dec",
    }
    row = apply_transformations(df, [one])[0].first()
    assert (row["ra"], row["dec"]) == expected


@pytest.mark.parametrize(("ra", "dec"), [("1:00:00", "91:00:00"), ("1:61:00", "0"), ("25:00:00", "0"), ("x", "0")])
def test_sky_coordinates_that_are_none(spark, ra, dec):
    df = spark.createDataFrame([(ra, dec)], "r string, d string")
    one = {
        "type": "skycoord_to_degrees",
        "ra_column": "r",
        "dec_column": "d",
        "output_ra_column": "ra",
        "output_dec_column": "dec",
    }
    with pytest.raises(Exception, match="outside|cannot be read"):
        apply_transformations(df, [one])[0].collect()


def test_sky_coordinates_wrap_numbers(spark):
    df = spark.createDataFrame([(-1.0, 0.1), (370.0, 0.2), (-1e-20, 0.3)], "r double, d double")
    one = {
        "type": "skycoord_to_degrees",
        "ra_column": "r",
        "dec_column": "d",
        "output_ra_column": "ra",
        "output_dec_column": "dec",
        "ra_unit": "deg",
        "dec_unit": "rad",
    }
    rows = apply_transformations(df, [one])[0].orderBy("d").collect()
    assert [r["ra"] for r in rows] == [359.0, 10.0, 0.0]
    assert rows[0]["dec"] == pytest.approx(math.degrees(0.1))


def test_replacements_are_simultaneous_and_type_guarded(spark):
    df = spark.createDataFrame([("a", 1, math.nan), ("b", 2, 2.5), (None, 3, 3.0)], "s string, i long, f double")
    out, _ = apply_transformations(
        df,
        [
            {"type": "replace_values", "column": "s", "replacements": [{"from": "a", "to": "b"}, {"from": "b", "to": "c"}]},
            {"type": "replace_values", "column": "i", "replacements": [{"from": 1, "to": 0.5}, {"from": "2", "to": 9}]},
            {"type": "replace_values", "column": "f", "replacements": [{"from": None, "to": -1}, {"from": True, "to": 7}]},
        ],
    )
    rows = {tuple(r) for r in out.collect()}
    assert rows == {("b", 0.5, -1.0), ("c", 2.0, 2.5), (None, 3.0, 3.0)}


@pytest.mark.parametrize(
    "bad",
    [
        {"type": "nope"},
        {"type": "cast", "column": "z", "dtype": "quaternion"},
        {"type": "absolute_value", "input_column": "absent", "output_column": "o"},
        {"type": "coalesce_redshift", "output_column": "o", "columns": []},
        {"type": "coalesce_redshift", "output_column": "o", "columns": ["z"], "labels": ["a", "b"]},
        {"type": "coalesce_redshift", "output_column": "o", "columns": ["z"], "invalid_value": math.nan},
        {"type": "velocity_to_redshift"},
        "text",
    ],
)
def test_bad_transformations(spark, bad):
    with pytest.raises(CatalogError):
        apply_transformations(redshifts(spark, [0.1]), [bad])


@pytest.mark.parametrize(
    "bad",
    [
        {},
        {"coordinates": {"ra_column": "ra"}, "redshift": {"column": "z"}},
        spec(redshift={"invalid_policy": "drop"}),
        spec(redshift={"invalid_value": "x"}),
        spec(redshift={"allow_blueshifts": "yes"}),
        spec(column_selection="ra"),
    ],
)
def test_bad_specs(bad):
    with pytest.raises(CatalogError):
        CurateSpec.from_dict(bad)


def test_bad_filters_and_positions(spark):
    df = redshifts(spark, [0.1])
    with pytest.raises(CatalogError, match="compares by"):
        curate(df, spec(redshift={"filters": [{"op": "~", "value": 1}]}))
    with pytest.raises(CatalogError, match="a number"):
        curate(df, spec(redshift={"filters": [{"op": "<", "value": "1"}]}))
    with pytest.raises(CatalogError, match="first or last"):
        curate(df, spec(generated_columns_position="middle"))
    with pytest.raises(CatalogError, match="leaves out"):
        curate(df, spec(column_selection=["object_id", "ra"]))


@pytest.mark.parametrize(("ra", "dec", "label"), [(360.0, 0.0, "RA"), (-0.1, 0.0, "RA"), (1.0, 90.0, "DEC")])
def test_coordinate_ranges(spark, ra, dec, label):
    df = spark.createDataFrame([(ra, dec, 0.1)], "ra double, dec double, z double")
    with pytest.raises(CatalogError, match=f"{label} column"):
        curate(df, spec())


def test_text_columns_must_hold_numbers(spark):
    df = spark.createDataFrame([("10.5", -1.0, 0.1)], "ra string, dec double, z double")
    assert curate(df, spec()).count() == 1
    df = spark.createDataFrame([("ten", -1.0, 0.1)], "ra string, dec double, z double")
    with pytest.raises(Exception, match="must be numeric"):
        curate(df, spec())


def test_chained_generated_columns_are_no_inputs():
    steps = [
        {"type": "velocity_to_redshift", "velocity_column": "v", "output_column": "zv"},
        {"type": "coalesce_redshift", "output_column": "zf", "columns": ["zs", "zv"]},
    ]
    assert required_inputs(["id", "ra", "dec", "zf"], steps, ["ra", "dec", "zf"]) == ["id", "ra", "dec", "v", "zs"]
    assert required_inputs([], steps, ["ra", "dec", "zf"]) is None


def test_write_validates_in_the_same_pass_and_leaves_nothing_invalid(spark, tmp_path):
    path = str(tmp_path / "out")
    names = curate_to(redshifts(spark, [0.1, 99.0]), spec(redshift={"invalid_policy": "flag"}), path)
    assert names == ["object_id", "ra", "dec", "z"]
    assert column(spark.read.parquet(path), "z") == [0.1, -1.0]
    assert path_exists(spark, path + "/_curation_manifest.json")
    with pytest.raises(CatalogError, match="already exists"):
        curate_to(redshifts(spark, [0.1]), spec(), path)
    with pytest.raises(CatalogError, match="outside the required range"):
        curate_to(redshifts(spark, [0.1, 99.0]), spec(), path, overwrite=True)
    assert column(spark.read.parquet(path), "z") == [0.1, -1.0]  # what was there stays
    with pytest.raises(CatalogError, match="outside the required range"):
        curate_to(redshifts(spark, [0.1, 99.0]), spec(), path + "2")
    assert not path_exists(spark, path + "2")


def test_curate_to_collection(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.0, -1.0, 0.1), (2, 11.0, -1.1, 0.2)], "object_id long, ra double, dec double, z double")
    path = str(tmp_path / "toy_curated")
    curate_to_collection(df, spec(column_selection=["object_id", "ra", "dec", "z"]), path)
    for part in ("collection.properties", "toy_curated/hats.properties", "toy_curated_5arcs/hats.properties"):
        assert path_exists(spark, f"{path}/{part}")
    back = read_spatial(spark, path)
    assert back.columns == ["object_id", "ra", "dec", "z", "_healpix_29"]
    assert column(back, "z") == [0.1, 0.2]
    # a spatial catalog is curated again, with a transformation
    again = str(tmp_path / "again")
    step = {"type": "add_constant_column", "name": "survey", "value": "S"}
    curate_to_collection(read_spatial(spark, path), spec(transformations=[step]), again, margin_arcsec=None)
    assert column(read_spatial(spark, again), "survey") == ["S", "S"]
    assert not path_exists(spark, f"{again}/again_5arcs")
    empty = spec(redshift={"filters": [{"op": ">", "value": 5}]})
    with pytest.raises(CatalogError):
        curate_to_collection(df, empty, str(tmp_path / "none"))


@pytest.mark.parametrize("blueshifts", [True, False])
def test_merged_filters_equal_their_parts(spark, blueshifts):
    """The interval a filter list folds into keeps exactly what the single comparisons keep."""
    import itertools
    import operator

    from skyloom.operators.validate import filter_redshift

    ops = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
    values = [-0.2, -0.1, -0.05, 0.0, 0.5, 1.0, 1.5, 19.9, 20.0, 25.0, None, math.nan]
    df = redshifts(spark, values).cache()
    single = [(op, t) for op in ops for t in (-0.1, 0.0, 0.5, 1.0, 20.0, 30.0)]
    low = -0.1 if blueshifts else 0.0
    combos = [[s] for s in single] + [list(c) for c in itertools.combinations(single[::5], 2)]
    combos += [[(">", 0.5), (">=", 0.5)], [("==", 0.5), ("!=", 0.5)], [("==", 1.0), ("==", 0.5)], [("!=", 0.5), ("!=", 1.0)]]
    for filters in combos:
        want = [v for v in values if v is not None and low < v < 20 and all(ops[o](v, t) for o, t in filters)]
        assert column(filter_redshift(df, "z", filters, blueshifts), "z") == want, filters


def test_single_floats_keep_their_type(spark):
    df = spark.createDataFrame([(0.5, 0.25), (99.0, 0.75)], "z float, y float")
    assert flag_redshift(df, "z").schema["z"].dataType.simpleString() == "float"
    assert [r["z"] for r in flag_redshift(df, "z").collect()] == [0.5, -1.0]
    step = {"type": "coalesce_redshift", "output_column": "best", "columns": ["z", "y"]}
    out, _ = apply_transformations(df, [step], True)
    assert out.schema["best"].dataType.simpleString() == "float" and [r["best"] for r in out.collect()] == [0.5, 0.75]

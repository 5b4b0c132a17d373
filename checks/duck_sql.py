"""The SQL each registered query is compared with, for DuckDB."""

from __future__ import annotations

import math

from checks.spark_queries import NAME_STEMS, TILE_ORDER, TILE_ROWS
from checks.views import CATALOG, view_sql

CAT, WIDE, SEXA, GAPS, VERT = (
    view_sql(n) for n in ("catalog", "wide_catalog", "sexagesimal", "gaps", "vertices")
)
CAT_COLUMNS = ", ".join(CATALOG)


def _d(value: float) -> str:
    return f"cast('{value!r}' as double)"


def _valid(c: str, low: float = -0.1) -> str:
    return f"({c} > {_d(low)} and {c} < 20)"


def _clean(c: str) -> str:
    return f"(case when not isnan({c}) then {c} end)"


def _wrap(c: str) -> str:
    """Angle wrapped to [0, 360)."""
    return f"(case when {c} % 360 < 0 then ({c} % 360 + 360) % 360 else {c} % 360 end)"


_C = "cast(299792.458 as double)"
_RA_HMS = "15.0*(ra_h + ra_m/60.0 + ra_s/3600.0)"
_DEC_DMS = "sign(dec_d)*(abs(dec_d) + dec_m/60.0 + dec_s/3600.0)"


def _pipeline(source: str) -> str:
    z = (
        f"coalesce(case when {_valid('z_spec', 0.0)} then z_spec end, case when {_valid('z_phot', 0.0)} then z_phot end,"
        f" case when {_valid('z_vel', 0.0)} then z_vel end, cast(-1 as double))"
    )
    label = (
        f"case when {_valid('z_spec', 0.0)} then 's' when {_valid('z_phot', 0.0)} then 'p'"
        f" when {_valid('z_vel', 0.0)} then 'v' else 'none' end"
    )
    return (
        f"select object_id, ra, dec, z_final, quality, z_vel, z_source, 'SAMPLE' as survey from (select *, {z} as z_final,"
        f" {label} as z_source from (select *, v_kms/{_C} as z_vel from {source}))"
        f" where {_valid('z_final', 0.0)} and z_final > {_d(0.05)} and z_final <= 4"
    )


def _stats(source: str, column: str, moments: bool = True) -> str:
    v = _clean(column)
    mean = f"round(avg({v}), 6)" if moments else "cast(null as double)"
    std = f"round(stddev_samp({v}), 6)" if moments else "cast(null as double)"
    return (
        f"select '{column}' as \"column\", count({v}) as count, count(*) - count({v}) as null_count, {mean} as mean,"
        f" {std} as std, min({v}) as min, max({v}) as max from {source}"
    )


def _describe(source: str, column: str) -> str:
    v = _clean(column)
    quartiles = ", ".join(f"round(quantile_cont({v}, {q}), 6) as q{int(q * 100)}" for q in (0.25, 0.5, 0.75))
    return (
        f"select '{column}' as \"column\", count({v}) as count, round(avg({v}), 6) as mean,"
        f" round(stddev_samp({v}), 6) as std, min({v}) as min, {quartiles}, max({v}) as max from {source}"
    )


def _histogram(source: str, column: str, bins: int, low: str, high: str, step: str) -> str:
    return (
        f"with v as (select {_clean(column)} as v from {source}),"
        f" r as (select {low} as lo, {high} as hi, {step} as st from v),"
        f" e as (select cast(i as integer) as bin, cast(i as double)*st + lo as lower,"
        f" case when i + 1 = {bins} then hi else cast(i + 1 as double)*st + lo end as upper"
        f" from (select distinct * from r), range({bins}) t(i))"
        f" select bin, lower, upper, count(v) as n from e left join v"
        f" on v >= lower and (v < upper or (bin = {bins - 1} and v = upper)) group by bin, lower, upper"
    )


def _sky(source: str) -> str:
    x0, xs, y0, ys = -math.pi, 2 * math.pi / 179, -math.pi / 2, math.pi / 89
    shifted = "(ra + 180)"
    return (
        f"with p as (select -radians({_wrap(shifted)} - 180) as x, radians(dec) as y from {source}),"
        f" xe as (select cast(i as integer) as ix, cast(i as double)*{_d(xs)} + {_d(x0)} as a, case when i = 178 then"
        f" {_d(math.pi)} else cast(i + 1 as double)*{_d(xs)} + {_d(x0)} end as b from range(179) t(i)),"
        f" ye as (select cast(i as integer) as iy, cast(i as double)*{_d(ys)} + {_d(y0)} as a, case when i = 88 then"
        f" {_d(math.pi / 2)} else cast(i + 1 as double)*{_d(ys)} + {_d(y0)} end as b from range(89) t(i)),"
        " q as (select ix, y from p join xe on x >= a and (x < b or (ix = 178 and x = b)))"
        " select ix, iy, count(*) as n from q join ye on y >= a and (y < b or (iy = 88 and y = b)) group by ix, iy"
    )


def index_sql(source: str, order: int, keep: str) -> str:
    """The nested sky index written out as SQL: ``keep`` columns plus ``idx``."""
    n = 1 << order
    bits = " + ".join(f"(((ix >> {i}) & 1) << {2 * i}) + (((iy >> {i}) & 1) << {2 * i + 1})" for i in range(order))
    return f"""(select {keep}, (face << {2 * order}) + {bits} as idx from (
      select *,
        case when eq then (case when fu = fv then fu | 4 when fu < fv then fu else fv + 8 end)
             when z >= 0 then q else q + 8 end as face,
        case when eq then v & {n - 1} when z >= 0 then {n - 1} - jb else ja end as ix,
        case when eq then {n - 1} - (u & {n - 1}) when z >= 0 then {n - 1} - ja else jb end as iy
      from (select *, u >> {order} as fu, v >> {order} as fv,
              least(cast(floor(tp*tm) as bigint), {n - 1}) as ja,
              least(cast(floor((cast(1 as double)-tp)*tm) as bigint), {n - 1}) as jb
        from (select *, za <= cast(2 as double)/cast(3 as double) as eq, cast(qd as bigint) as q, tt - qd as tp,
                case when za < {_d(0.99)} then cast({n} as double)*sqrt(cast(3 as double)*(cast(1 as double)-za))
                     else cast({n} as double)*cd/sqrt((cast(1 as double)+za)/cast(3 as double)) end as tm,
                cast(floor(cast({n} as double)*({_d(0.5)}+tt) - {_d(0.75)}*cast({n} as double)*z) as bigint) as u,
                cast(floor(cast({n} as double)*({_d(0.5)}+tt) + {_d(0.75)}*cast({n} as double)*z) as bigint) as v
          from (select *, abs(z) as za, least(cast(3 as double), floor(tt)) as qd
            from (select *, sin(radians(dec)) as z, cos(radians(dec)) as cd, {_wrap('ra')}/cast(90 as double) as tt
              from {source}))))))"""


_TILES = (
    f"cells as materialized (select object_id, idx from {index_sql(CAT, TILE_ORDER, 'object_id')}),"
    f" levels as materialized (select l as \"Norder\", idx >> (2*({TILE_ORDER} - l)) as \"Npix\","
    f" idx >> (2*({TILE_ORDER} - l + 1)) as parent, count(*) as n_rows"
    f" from cells, (select unnest(range({TILE_ORDER + 1}))::integer as l) group by 1, 2, 3),"
    f' tiles as materialized (select t."Norder", t."Npix", t.n_rows from levels t left join levels p on p."Norder" = t."Norder" - 1'
    f' and p."Npix" = t.parent where (t.n_rows <= {TILE_ROWS} or t."Norder" = {TILE_ORDER})'
    f" and (p.n_rows is null or p.n_rows > {TILE_ROWS}))"
)
_ASSIGNED = (
    f'with {_TILES}, placed as (select object_id, l as o, idx >> (2*({TILE_ORDER} - l)) as p from cells,'
    f" (select unnest(range({TILE_ORDER + 1}))::integer as l))"
    ' select object_id, "Norder", "Npix"//10000*10000 as "Dir", "Npix"{} from placed join tiles on o = "Norder" and p = "Npix"'
)


def _finite(c: str) -> str:
    return f"coalesce(isfinite({c}), false)"


_SPATIAL = (
    f"count(case when not {_finite('ra')} then 1 end) as nonfinite_ra,"
    f" count(case when not {_finite('dec')} then 1 end) as nonfinite_dec,"
    f" count(case when {_finite('ra')} and (ra < 0 or ra >= 360) then 1 end) as ra_outside_range,"
    f" count(case when {_finite('dec')} and (dec < -90 or dec > 90) then 1 end) as dec_outside_range,"
    f" count(case when {_finite('ra')} and {_finite('dec')} then 1 end) as valid_pairs"
)


def _warning_rows(nothing: bool, footprint: bool) -> str:
    miss_z = "count(case when z_nan is null or isnan(z_nan) then 1 end)"
    rows = [
        ("n = 0", "empty_catalog", None, "'Catalog is empty.'"),
        ("nonfinite_ra > 0", "nonfinite_ra", "ra", "'Column ra: ' || nonfinite_ra || ' non-finite coordinate values.'"),
        ("nonfinite_dec > 0", "nonfinite_dec", "dec", "'Column dec: ' || nonfinite_dec || ' non-finite coordinate values.'"),
        ("ra_outside_range > 0", "ra_outside_range", "ra", "'Column ra: ' || ra_outside_range || ' values outside [0, 360).'"),
        ("dec_outside_range > 0", "dec_outside_range", "dec", "'Column dec: ' || dec_outside_range || ' values outside [-90, 90].'"),
        ("valid_pairs = 0", "no_valid_pairs", None, "'Spatial plot has no finite RA/Dec pairs.'"),
        ("n > 0 and m_z = n", "all_null", "z_nan", "'Column ''z_nan'' is entirely null.'"),
        ("f_z = 0", "no_finite_values", "z_nan", "'Configured numeric column ''z_nan'' has no finite values.'"),
        (
            "f_z > 0 and in_z = 0",
            "none_in_range",
            "z_nan",
            "'Column ''z_nan'' has no values inside histogram range [100.0, 200.0].'",
        ),
        ("n = 0 or m_note = n", "no_categories", "note", "'Configured categorical column ''note'' has no non-null categories.'"),
    ]
    if nothing:
        rows += [
            ("n > 0", "all_null", "nothing", "'Column ''nothing'' is entirely null.'"),
            ("true", "no_finite_values", "nothing", "'Configured numeric column ''nothing'' has no finite values.'"),
            ("true", "no_categories", "nothing", "'Configured categorical column ''nothing'' has no non-null categories.'"),
        ]
    parts = []
    for test, code, name, message in rows:
        shown = f"'{name}'" if name else "cast(null as varchar)"
        parts.append(f"select '{code}' as code, {shown} as \"column\", {message} as message from s where {test}")
    if footprint:
        text = "'Survey edge: footprint has no curve with at least two finite points.'"
        parts.append(f"select 'unusable_footprint' as code, cast(null as varchar) as \"column\", {text} as message")
    return (
        f"with s as (select count(*) as n, {_SPATIAL}, {miss_z} as m_z, count(case when note is null then 1 end) as m_note,"
        f" count(case when {_finite('z_nan')} then 1 end) as f_z,"
        f" count(case when {_finite('z_nan')} and z_nan between 100 and 200 then 1 end) as in_z from {GAPS})"
        f" {' union all '.join(parts)}"
    )


_CURVE_POINTS = (
    f"p as (select cast(region_id as varchar) as curve, vertex_id, ra_deg as ra, dec_deg as dec,"
    f" -radians({_wrap('(ra_deg + 180)')} - 180) as x from {VERT} where ring_type = 'exterior')"
)

_SEG = (
    f"with {_CURVE_POINTS},"
    f" j as (select *, case when abs(x - lag(x) over w) > {_d(math.pi)} then 1 else 0 end as cut from p"
    " window w as (partition by curve order by vertex_id)),"
    " s as (select *, cast(sum(cut) over (partition by curve order by vertex_id) as bigint) as segment from j),"
    " c as (select *, count(*) over (partition by curve, segment) as k from s)"
    " select curve, segment, cast(vertex_id as double) as position from c where k > 1"
)


# Name patterns of each semantic category, written again so that the SQL does not use the list it tests.
_NAME_PATTERNS = {
    "ra": [
        r"^ra$",
        r"(^|_)ra_deg($|_)",
        r"(^|_)target_ra($|_)",
        r"(^|_)obsra($|_)",
        r"(^|_)ra_j2000($|_)",
        r"^alpha",
        r"(^|_)right_ascension($|_)",
    ],
    "dec": [
        r"^dec$",
        r"dec_deg",
        r"target_dec",
        r"obsdec",
        r"dec_j2000",
        r"^delta",
        r"(^|_)declination($|_)",
    ],
    "redshift": [
        r"^z$",
        r"redshift",
        r"zspec",
        r"z_spec",
        r"zphot",
        r"z_phot",
        r"best_z",
        r"z_ml",
        r"z_helio",
    ],
    "quality": [
        r"quality",
        r"qual",
        r"qop",
        r"(^|_)flag($|_)",
        r"zflag",
        r"zwarn",
        r"zwarning",
        r"z_flag",
        r"vi_quality",
        r"confidence",
    ],
    "redshift_error": [
        r"(^|_)z_err($|_)",
        r"^zerr$",
        r"(^|_)err_z($|_)",
        r"(^|_)z_error($|_)",
        r"(^|_)sigma_z($|_)",
    ],
    "id": [
        r"^id$",
        r"(^|_)objectid($|_)",
        r"(^|_)object_id($|_)",
        r"(^|_)targetid($|_)",
        r"(^|_)specid($|_)",
        r"(^|_)catalogid($|_)",
        r"^tileid$",
    ],
    "object_type": [
        r"(^|_)class($|_)",
        r"(^|_)subclass($|_)",
        r"(^|_)objtype($|_)",
        r"(^|_)spectype($|_)",
        r"(^|_)subtype($|_)",
        r"(^|_)eta_type($|_)",
        r"^type$",
    ],
}


def _stem_name() -> str:
    cases = " ".join(f"when {i} then '{s}'" for i, s in enumerate(NAME_STEMS))
    return f"(case length(word) % {len(NAME_STEMS)} {cases} end) || word"


def _categories() -> str:
    return " union all ".join(
        f"select name, '{k}' as category from names where "
        + " or ".join(f"regexp_matches(name, '{p}', 'i')" for p in patterns)
        for k, patterns in _NAME_PATTERNS.items()
    )


def _unique(column: str, text: str) -> str:
    return (
        f"select '{column}' as \"column\", value, cast(rank as integer) as rank from (select value, row_number() over"
        f" (order by value) as rank from (select distinct trim({text}) as value from {GAPS}) where value <> '') where rank <= 10"
    )


def _missing(columns: dict[str, bool], source: str = GAPS) -> str:
    parts = []
    for name, is_float in columns.items():
        test = f"{name} is null or isnan({name})" if is_float else f"{name} is null"
        k = f"count(case when {test} then 1 end)"
        parts.append(
            f"select '{name}' as \"column\", {k} as missing, round({k}*cast(100 as double)/count(*), 9) as missing_pct from {source}"
        )
    return " union all ".join(parts)


_Z_FLAG = f"case when {_valid('z_spec')} then z_spec else cast(-1 as double) end"
_RANGES = ", ".join(f"{f}({c}) as {k}_{f}" for k, c in (("ra", "ra"), ("dec", "dec"), ("z", "z_spec")) for f in ("min", "max"))

SQL: dict[str, str] = {
    "scan_csv": f"select {CAT_COLUMNS} from {CAT}",
    "scan_whitespace": f"select object_id, ra, dec, z_spec, replace(object_type, ' ', '_') as object_type from {CAT}",
    "scan_parquet": "select l_orderkey, l_linenumber, l_extendedprice from lineitem",
    "scan_fits": f"select object_id, ra, dec, coalesce(z_spec, cast('NaN' as double)) as z_spec, quality, object_type from {CAT}",
    "scan_spatial": f"select object_id, ra, dec, z_spec, quality from {CAT}",
    "scan_footprint": "select cast(region_id as bigint) as region_id, ring_type, cast(vertex_id as double) as vertex_id,"
    f" ra_deg, dec_deg from {VERT}",
    "union_strict": f"select {CAT_COLUMNS} from {CAT}",
    "union_outer": "select object_id, ra, dec, z_spec, case when quality <> 'O' then z_phot end as z_phot,"
    " case when quality = 'P' then floor(v_kms) else v_kms end as v_kms, quality, object_type,"
    f" case when quality = 'P' then object_id*2 end as extra from {CAT}",
    "t_cast": f"select cast(object_id as varchar) as object_id, cast(trunc(v_kms) as bigint) as v_kms from {CAT}",
    "t_constant": "select object_id, 'SAMPLE' as survey, cast(2 as bigint) as release, true as public,"
    f" cast(null as varchar) as remark from {CAT}",
    "t_abs": f"select object_id, cast(abs(dec_d) as bigint) as dec_abs from {SEXA}",
    "t_sign": f"select object_id, case when z_spec < 0 then 'neg' else '+' end as sign from {CAT}",
    "t_replace": "select object_id, case quality when 'F' then 'O' when 'O' then 'open' end as quality,"
    f" nullif(z_phot, -1) as z_phot, coalesce(z_spec, cast(-9 as double)) as z_spec from {CAT}",
    "t_ra_hms": f"select object_id, {_RA_HMS} as ra from {SEXA}",
    "t_dec_dms": f"select object_id, {_DEC_DMS} as dec from {SEXA}",
    "t_dec_dms_zero_rows": "select count(case when dec_d = 0 and (dec_m <> 0 or dec_s <> 0) then 1 end) as zero_degree_rows"
    f" from {SEXA}",
    "t_velocity": f"select object_id, v_kms/{_C} as redshift, z_phot/{_C} as redshift_err from {CAT}",
    "t_coalesce_z": f"select object_id, case when {_valid('z_spec')} then z_spec when {_valid('z_phot')} then z_phot"
    f" else cast(-1 as double) end as z_final from {CAT}",
    "t_coalesce_z_label": f"select object_id, case when {_valid('z_spec')} then z_spec when {_valid('z_phot')} then z_phot"
    f" else cast(-1 as double) end as z_final, case when {_valid('z_spec')} then 's' when {_valid('z_phot')} then 'p'"
    f" else 'none' end as z_source from {CAT}",
    "t_skycoord": "select o_orderkey as object_id, (cast(o_custkey % 24 as double) + cast(o_orderkey % 60 as double)/60.0"
    " + cast(o_orderkey*7 % 60 as double)/3600.0)*15.0 as ra, (case when o_orderkey % 2 = 0 then -1 else 1 end)*"
    "(cast(o_orderkey % 90 as double) + cast(o_custkey % 60 as double)/60.0 + cast(o_custkey*11 % 60 as double)/3600.0)"
    " as dec from orders",
    "t_skycoord_numbers": f"select object_id, {_wrap('((ra/15.0 - 12.0)*15.0)')} as ra, round(dec, 9) as dec from {CAT}",
    "t_pipeline": f"select object_id, {_RA_HMS} as ra, case when dec_d < 0 then '-' else '+' end as dec_sign,"
    f" {_DEC_DMS} as dec, abs({_DEC_DMS}) as dec_abs from {SEXA}",
    "project_required": f"select object_id, ra, dec, quality, v_kms, z_spec, z_phot from {CAT}",
    "project_final_first": f"select 'SAMPLE' as survey, dec, ra, {_Z_FLAG} as z_spec, object_id from {CAT}",
    "project_final_last": f"select object_id, ra, dec, {_Z_FLAG} as z_spec, z_phot, v_kms, quality, object_type,"
    f" 'SAMPLE' as survey from {CAT}",
    "standard_ranges": f"select {_RANGES}, count(case when not coalesce({_valid('z_spec')}, false) then 1 end)"
    f" as invalid_redshift_count from {CAT}",
    "coord_violations": f"select object_id, ra, dec from {GAPS} where (not isnan(ra) and (ra < 0 or ra >= 360))"
    " or (not isnan(dec) and (dec <= -90 or dec >= 90))",
    "z_violations": f"select object_id, z_spec from {CAT} where not coalesce({_valid('z_spec', 0.0)}, false)",
    "z_flag": f"select object_id, {_Z_FLAG} as z_spec from {CAT}",
    "z_flag_no_blueshift": f"select object_id, case when {_valid('z_spec', 0.0)} then z_spec else cast(-9 as double) end"
    f" as z_spec from {CAT}",
    "z_keep": f"select object_id, z_spec from {CAT}",
    "z_filter_range": f"select object_id, z_spec from {CAT} where {_valid('z_spec')} and z_spec > {_d(1.6)} and z_spec < 9",
    "z_filter_ops": f"select object_id, z from (select object_id, round(z_nan, 1) as z from {GAPS}) where not isnan(z)"
    f" and {_valid('z')} and z >= {_d(0.5)} and z <= 3 and z <> {_d(1.5)}".replace("select object_id, z from (", "select object_id, z as z_nan from ("),
    "spatial_coord_check": "select count(r) as ra_count, min(r) as ra_min, max(r) as ra_max, count(d) as dec_count,"
    f" min(d) as dec_min, max(d) as dec_max from (select {_clean('ra')} as r, {_clean('z_nan')} as d from {GAPS})",
    "numeric_stats": " union all ".join(_stats(GAPS, c) for c in ("ra", "z_nan", "nothing", "v_kms")),
    "numeric_stats_by_group_merged": " union all ".join(_stats(CAT, c) for c in ("ra", "z_spec", "v_kms")),
    "categorical_uniques": _unique("flag", "case when flag then 'True' when not flag then 'False' end")
    + " union all "
    + _unique("note", "note"),
    "candidate_columns": f"with names as (select distinct {_stem_name()} as name from (select"
    " unnest(string_split_regex(text, '[^A-Za-z]+')) as word from documents) where word <> '') "
    + _categories(),
    "sample_head": f"select ra, dec, z_spec, z_phot, quality, object_id, v_kms, object_type from {CAT} order by object_id limit 5",
    "spatial_stats": " union all ".join(_stats(GAPS, c, False) for c in ("ra", "z_nan")),
    "footer_stats": " union all ".join(
        f"select '{c}' as \"column\", count({c}) as count, count(*) - count({c}) as null_count, cast(null as double) as mean,"
        f" cast(null as double) as std, cast(min({c}) as double) as min, cast(max({c}) as double) as max from lineitem"
        for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    ),
    "row_col_counts": f"select count(*) as n_rows, {len(CATALOG)} as n_columns from {CAT}",
    "semantic_warnings": "select 'no_dec' as code, '' as columns, 'No DEC candidate columns were found.' as message"
    " union all select 'several_redshifts', 'z_spec, z_phot', 'Multiple redshift candidate columns were found: z_spec, z_phot.'"
    " union all select 'ra_not_numeric', 'OBSRA', 'RA candidate columns are not numeric: OBSRA.'"
    " union all select 'redshift_nulls', 'z_spec, z_phot', 'Redshift candidate columns have many null values: z_spec ('"
    " || printf('%.1f', count(case when z_nan is null or isnan(z_nan) then 1 end)*cast(100 as double)/count(*))"
    f" || '% null), z_phot (100.0% null).' from {GAPS}",
    "qa_row_count": f"select count(*) as n_rows from {CAT}",
    "qa_missing": _missing(
        {
            "object_id": False,
            "ra": True,
            "dec": True,
            "z_nan": True,
            "z_inf": True,
            "v_kms": True,
            "nothing": True,
            "z_text": False,
            "flag": False,
            "note": False,
        }
    ),
    "qa_numeric_diag": f"select count(case when {_finite('z_inf')} then 1 end) as finite, count(case when {_finite('z_inf')}"
    f" and z_inf between {_d(0.5)} and 2 then 1 end) as in_range from {GAPS}",
    "qa_numeric_diag_text": "select count(v) as finite, count(case when v between 10 and 20 then 1 end) as in_range"
    f" from (select try_cast(z_text as double) as v from {GAPS})",
    "qa_spatial_diag": f"select {_SPATIAL} from {GAPS}",
    "qa_range": f"select min({_clean('z_inf')}) as min_value, max({_clean('z_inf')}) as max_value from {GAPS}",
    "qa_hist1d": _histogram(CAT, "z_spec", 50, _d(0.0), _d(4.0), _d(4.0 / 50)),
    "qa_hist1d_auto": _histogram(
        CAT, "z_spec", 37, "min(v) over ()", "max(v) over ()", "(max(v) over () - min(v) over ())/cast(37 as double)"
    ),
    "qa_hist1d_wide": _histogram(WIDE, "z_spec", 50, _d(0.0), _d(4.0), _d(4.0 / 50)),
    "qa_hist2d": _sky(CAT),
    "qa_hist2d_wide": _sky(WIDE),
    "qa_value_counts": f"select flag as value, count(*) as n from {GAPS} group by 1",
    "qa_category_counts": f"select note as value, count(*) as n from {GAPS} where note is not null group by 1",
    "qa_describe": " union all ".join(_describe(GAPS, c) for c in ("ra", "z_nan", "nothing")),
    "qa_describe_wide": " union all ".join(_describe(WIDE, c) for c in ("ra", "z_spec", "z_phot")),
    "qa_warnings": _warning_rows(nothing=True, footprint=False),
    "footprint_usable": f"select coalesce(max(n) >= 2, false) as usable from (select count(case when {_finite('ra_deg')} and"
    f" {_finite('dec_deg')} then 1 end) as n from {VERT} where ring_type = 'exterior' group by region_id)",
    "footprint_curves": f"with {_CURVE_POINTS} select curve, row_number() over (partition by curve order by vertex_id) as place,"
    " ra, dec from p",
    "footprint_segments": _SEG,
    "healpix_index": f"select a.object_id, a.idx as cell_3, b.idx as cell_6, c.idx as _healpix_29 from"
    f" {index_sql(CAT, 3, 'object_id')} a join {index_sql(CAT, 6, 'object_id')} b using (object_id)"
    f" join {index_sql(CAT, 29, 'object_id')} c using (object_id)",
    "healpix_index_wide": f"select idx >> 50 as cell, count(*) as n from {index_sql(WIDE, 29, 'object_id')} group by 1",
    "partition_map": f'with {_TILES} select "Norder", "Npix", n_rows from tiles',
    "tile_assign": _ASSIGNED.format(""),
    "tile_sorted": _ASSIGNED.format(', row_number() over (partition by "Norder", "Npix" order by object_id) as rank'),
    "sample_random": f"select {CAT_COLUMNS} from {CAT} order by md5('42:' || object_id), object_id limit 20",
    "x_curate_pipeline": _pipeline(CAT),
    "x_curate_wide": _pipeline(WIDE),
    "x_curate_write": _pipeline(CAT),
    "x_curate_spatial": _pipeline(CAT),
    "x_prepare_union": f"select object_id, quality, case when quality <> 'O' then v_kms end as v_kms from {CAT}",
    "x_prepare": f"select {CAT_COLUMNS} from {CAT}",
    "x_inspect": " union all ".join(_stats(GAPS, c) for c in ("ra", "z_nan", "nothing")),
    "x_qa_row_count": f"select count(*) as n_rows from {CAT}",
    "x_qa_missing": _missing({"ra": True, "dec": True, "z_spec": True, "z_phot": True, "quality": False}, CAT),
    "x_qa_describe": " union all ".join(_describe(CAT, c) for c in ("ra", "dec", "z_spec", "z_phot")),
    "x_qa_redshift_histogram": _histogram(
        CAT, "z_spec", 37, "min(v) over ()", "max(v) over ()", "(max(v) over () - min(v) over ())/cast(37 as double)"
    ),
    "x_qa_counts": f"select quality as value, count(*) as n from {CAT} where quality is not null group by 1",
    "x_qa_tables": _warning_rows(nothing=False, footprint=True),
}

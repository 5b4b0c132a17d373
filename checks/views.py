"""The sky-catalog views all queries read, written once for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column name -> expression valid in Spark SQL and in DuckDB.
CATALOG = {
    "object_id": "o_orderkey",
    "ra": "cast((o_orderkey*7919 + o_custkey*104729) % 3600000 as double)/10000.0",
    "dec": "cast((o_orderkey*6007 + o_custkey*1299709) % 1799999 + 1 as double)/10000.0 - 90.0",
    "z_spec": "case when o_orderkey % 11 = 0 then cast(null as double) when o_orderkey % 13 = 0 then cast(99.0 as double)"
    " else o_totalprice/100000.0 - 0.3 end",
    "z_phot": "case when o_orderkey % 7 = 0 then cast(-1.0 as double) else o_totalprice/90000.0 end",
    "v_kms": "o_totalprice*0.9",
    "quality": "o_orderstatus",
    "object_type": "o_orderpriority",
}

# The same catalog over the largest table, for runs that should weigh something.
WIDE_CATALOG = {
    "object_id": "l_orderkey*8 + l_linenumber",
    "ra": "cast((l_orderkey*7919 + l_partkey*104729 + l_linenumber*15485863) % 3600000 as double)/10000.0",
    "dec": "cast((l_orderkey*6007 + l_partkey*1299709 + l_linenumber*32452843) % 1799999 + 1 as double)/10000.0 - 90.0",
    "z_spec": "case when l_orderkey % 11 = 0 then cast(null as double) when l_orderkey % 13 = 0 then cast(99.0 as double)"
    " else l_extendedprice/20000.0 - 0.3 end",
    "z_phot": "case when l_orderkey % 7 = 0 then cast(-1.0 as double) else l_extendedprice/18000.0 end",
    "v_kms": "l_extendedprice*0.9",
    "quality": "l_returnflag",
    "object_type": "l_linestatus",
}

# Sexagesimal coordinates, as numbers and as text.
SEXAGESIMAL = {
    "object_id": "o_orderkey",
    "ra_h": "cast(o_custkey % 24 as double)",
    "ra_m": "cast(o_orderkey % 60 as double)",
    "ra_s": "cast((o_orderkey*7 % 600) as double)/10.0",
    "dec_d": "cast(o_orderkey % 179 - 89 as double)",
    "dec_m": "cast(o_custkey % 60 as double)",
    "dec_s": "cast((o_custkey*11 % 600) as double)/10.0",
    "ra_text": "concat(cast(o_custkey % 24 as varchar(9)), ':', cast(o_orderkey % 60 as varchar(9)), ':',"
    " cast(o_orderkey*7 % 60 as varchar(9)))",
    "dec_text": "concat(case when o_orderkey % 2 = 0 then '-' else '+' end, cast(o_orderkey % 90 as varchar(9)), 'd',"
    " cast(o_custkey % 60 as varchar(9)), 'm', cast(o_custkey*11 % 60 as varchar(9)), 's')",
}

# Columns with every kind of missing or non-finite value.
GAPS = {
    "object_id": "o_orderkey",
    "ra": "case when o_orderkey % 17 = 0 then cast('NaN' as double) when o_orderkey % 19 = 0 then cast(null as double)"
    " else cast((o_orderkey*7919) % 3900000 as double)/10000.0 - 5.0 end",
    "dec": "case when o_orderkey % 23 = 0 then cast('Infinity' as double)"
    " else cast((o_orderkey*6007) % 1900000 as double)/10000.0 - 95.0 end",
    "z_nan": "case when o_orderkey % 5 < 3 then cast('NaN' as double) when o_orderkey % 29 = 0 then cast(null as double)"
    " else o_totalprice/100000.0 end",
    "z_inf": "case when o_orderkey % 31 = 0 then cast('-Infinity' as double) when o_orderkey % 37 = 0"
    " then cast('NaN' as double) else o_totalprice/100000.0 end",
    "v_kms": "o_totalprice*0.9",
    "nothing": "cast(null as double)",
    "z_text": "case when o_orderkey % 10 = 0 then 'bad' else cast(o_orderkey % 500 as varchar(9)) end",
    "flag": "case when o_orderkey % 41 = 0 then cast(null as boolean) else o_custkey % 2 = 0 end",
    "note": "case when o_orderkey % 3 = 0 then concat('  ', o_orderpriority, ' ') when o_orderkey % 43 = 0 then '  '"
    " else concat(o_orderstatus, cast(o_custkey as varchar(9))) end",
}

# Footprint vertices: five regions over all orders, some rings interior, some points unusable.
VERTICES = {
    "region_id": "o_custkey % 5",
    "ring_type": "case when o_orderkey % 10 = 0 then 'interior' else 'exterior' end",
    "vertex_id": "o_orderkey",
    "ra_deg": "cast((o_orderkey*7919 + o_custkey*104729) % 3600000 as double)/10000.0",
    "dec_deg": "cast((o_orderkey*6007 + o_custkey*1299709) % 1799999 + 1 as double)/10000.0 - 90.0",
}

_TABLE = {
    "catalog": ("orders", CATALOG),
    "wide_catalog": ("lineitem", WIDE_CATALOG),
    "sexagesimal": ("orders", SEXAGESIMAL),
    "gaps": ("orders", GAPS),
    "vertices": ("orders", VERTICES),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = _TABLE[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def view_sql(name: str) -> str:
    table, columns = _TABLE[name]
    return f"(select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {table})"

"""Connected components of a graph given by its edges, by alternating stars.

Large star hangs a vertex's larger neighbours on its smallest one, small star its smaller
ones; edges end up as (vertex, smallest vertex of its component). The number of edges never
grows, and a vertex with very many neighbours is only the key of joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.session import as_table


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex but the roots. ``edges``: two columns of comparable values, none null."""
    edges = edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = as_table(edges, "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    last, now = None, mark(edges)
    while now != last and now[0]:
        edges = as_table(_small(_large(edges)), "edges")
        last, now = now, mark(edges)
    return edges.withColumnRenamed("v", "root")

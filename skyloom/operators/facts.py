"""Tables that come from one row of aggregates, so that one pass over a catalog serves any number of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

Lookup = Callable[[str], Column]


@dataclass(frozen=True)
class Facts:
    """What a table needs from the pass, and its rows.

    Equal keys of ``aggregates`` stand for equal aggregates, also between tables of one
    catalog. ``rows`` makes structs of one type; a null struct is no row.
    """

    aggregates: Mapping[str, Column]
    rows: Callable[[Lookup], Sequence[Column]]
    schema: str


def _rows(facts: Facts, keys: Sequence[str]) -> Column | None:
    place = {key: f"a{i}" for i, key in enumerate(keys)}
    structs = facts.rows(lambda key: F.col(place[key]))
    return F.array_compact(F.array(*structs)) if structs else None


def _one_row(df: DataFrame, aggregates: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates.values())])


def table(df: DataFrame, facts: Facts) -> DataFrame:
    """One table, lazily."""
    rows = _rows(facts, list(facts.aggregates))
    if rows is None:
        return df.sparkSession.createDataFrame([], facts.schema)
    return _one_row(df, facts.aggregates).select(F.inline(rows))


def tables(df: DataFrame, parts: Mapping[str, Facts]) -> dict[str, list[Row]]:
    """The rows of all tables after a single pass. They are as many as the catalog has columns, times a small number."""
    merged: dict[str, Column] = {}
    for facts in parts.values():
        for key, aggregate in facts.aggregates.items():
            merged.setdefault(key, aggregate)
    found = {name: _rows(facts, list(merged)) for name, facts in parts.items()}
    wanted = [rows.alias(f"t{i}") for i, rows in enumerate(found.values()) if rows is not None]
    if not wanted:
        return {name: [] for name in parts}
    row = _one_row(df, merged).select(*wanted).collect()[0]
    return {name: [] if rows is None else row[f"t{i}"] for i, (name, rows) in enumerate(found.items())}

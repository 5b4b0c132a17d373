"""Exact quantiles from two scans, without gathering a column anywhere.

``percentile`` keeps every distinct value of a column in one task. Here a
sketch of the first scan only brackets each wanted rank. The second scan counts
up to the ends of the brackets and writes the rows strictly inside, a
small share of all, to a table of its own. There they are bracketed again until
they are few, and those few are counted per value. Ranks are tracked by exact
counts, and copies of a bracket end are counted and left out, so neither the
sketch's error nor a value that fills a third of the catalog changes the answer.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from skyloom.session import as_table, scratch_scope

SKETCH_ACCURACY = 10_000
FEW_ROWS = 5_000


class _Target:
    """One wanted rank (0-based) of one column and the open bracket known to hold it."""

    def __init__(self, column: int, rank: int, total: int):
        self.column, self.rank = column, rank
        self.low: float | None = None  # None: no bound on that side
        self.high: float | None = None
        self.below, self.inside = 0, total  # exact counts: not above low, and strictly inside
        self.value: float | None = None

    def share(self) -> float:
        return (self.rank - self.below + 0.5) / self.inside


_Bracket = tuple[_Target, float, float]


#: The value of a column by its place, NULL in rows that have none.
_At = Callable[[int], Column]


def _of_long(column: int) -> Column:
    """Rows (c, v): place of the column and value."""
    return F.when(F.col("c") == column, F.col("v"))


def _inside(v: Column, low: float | None, high: float | None) -> Column:
    test = v.isNotNull()
    if low is not None:
        test &= v > F.lit(low)
    if high is not None:
        test &= v < F.lit(high)
    return test


def around(fractions: Sequence[float], accuracy: int = SKETCH_ACCURACY) -> list[float]:
    """Two fractions for each one, between which its rank lies if a sketch errs by no more than its accuracy."""
    slack = 2.0 / accuracy
    return [x for p in fractions for x in (max(0.0, p - slack), min(1.0, p + slack))]


def sketch(value: Column, fractions: Sequence[float], accuracy: int = SKETCH_ACCURACY) -> Column:
    return F.percentile_approx(value, list(fractions), accuracy)


def _long(values: DataFrame, columns: Sequence[str], kept: Sequence[Column] | None = None) -> DataFrame:
    """(c, v): place of the column and value, without NULLs. ``kept`` has a test for each column."""
    tests = [F.col(c).isNotNull() for c in columns] if kept is None else kept
    pairs = [
        F.when(test, F.struct(F.lit(i).alias("c"), F.col(c).alias("v")))
        for i, (c, test) in enumerate(zip(columns, tests))
    ]
    # The plain test first drops nearly all rows before any array is built.
    return values.where(reduce(operator.or_, tests)).select(F.inline(F.array_compact(F.array(*pairs))))


def _end_counts(brackets: Sequence[_Bracket], at: _At = _of_long) -> dict[tuple, tuple[Column, Column]]:
    """For each bracket's end the rows of its target that are under it, and up to it."""
    counts = {}
    for t, *ends in brackets:
        for end in ends:
            v = at(t.column)
            here = _inside(v, t.low, t.high)
            under, upto = F.count_if(here & (v < F.lit(end))), F.count_if(here & (v <= F.lit(end)))
            counts[t.column, t.low, t.high, end] = under, upto
    return counts


def _aggregates(counts: Mapping[tuple, tuple[Column, Column]]) -> list[Column]:
    pairs = counts.values()
    return [c.alias(f"{side}{i}") for i, pair in enumerate(pairs) for side, c in zip(("under", "upto"), pair)]


def _tighten(brackets: Sequence[_Bracket], counts: Mapping[tuple, tuple[Column, Column]], row: Mapping[str, int]) -> None:
    """Keep the part of every proposed bracket that has the rank."""
    found = {key: (row[f"under{i}"], row[f"upto{i}"]) for i, key in enumerate(counts)}
    for t, low, high in brackets:
        under_low, upto_low = found[t.column, t.low, t.high, low]
        under_high, upto_high = found[t.column, t.low, t.high, high]
        rank = t.rank - t.below
        if rank < under_low:
            t.high, t.inside = low, under_low
        elif rank < upto_low:
            t.value = low
        elif rank < under_high:
            t.low, t.high, t.below, t.inside = low, high, t.below + upto_low, under_high - upto_low
        elif rank < upto_high:
            t.value = high
        else:
            t.low, t.below, t.inside = high, t.below + upto_high, t.inside - upto_high


def _held(
    values: DataFrame, columns: Sequence[str], targets: Sequence[_Target], proposed: Sequence[_Bracket]
) -> DataFrame:
    """The second scan: tightens the brackets and returns a table that has all rows of every open one."""
    ends = {id(t): (low, high) for t, low, high in proposed}
    tests = [F.lit(False)] * len(columns)
    for i, low, high in dict.fromkeys((t.column, *ends.get(id(t), (None, None))) for t in targets):
        tests[i] |= _inside(F.col(columns[i]), low, high)
    counts = _end_counts(proposed, lambda i: F.col(columns[i]))
    seen = Observation()
    held = as_table(_long(values.observe(seen, *_aggregates(counts)), columns, tests), "quantile-rows")
    _tighten(proposed, counts, seen.get)
    # Only a sketch that errs by more than it promises leaves a rank outside its bracket; the source has it still.
    missed = any(t.value is None and (t.low, t.high) != (low, high) for t, low, high in proposed)
    return _long(values, columns) if missed else held


def _sketched(long: DataFrame, targets: Sequence[_Target], accuracy: int) -> list[_Bracket]:
    wanted = [sketch(F.when(_inside(_of_long(t.column), t.low, t.high), F.col("v")), around([t.share()], accuracy), accuracy) for t in targets]
    row = long.agg(*[s.alias(f"s{i}") for i, s in enumerate(wanted)]).collect()[0]
    return [(t, *row[f"s{i}"]) for i, t in enumerate(targets)]


def _pick(long: DataFrame, targets: Sequence[_Target]) -> None:
    """Count the few bracketed values and read each rank off a running sum per bracket."""
    spans: dict[tuple[int, float | None, float | None], list[_Target]] = {}
    for t in targets:
        spans.setdefault((t.column, t.low, t.high), []).append(t)
    tests = [_inside(_of_long(column), low, high) for column, low, high in spans]
    # Spans may overlap.
    held = F.array_compact(F.array(*[F.when(test, F.lit(i)) for i, test in enumerate(tests)]))
    few = long.where(reduce(operator.or_, tests)).select(F.explode(held).alias("span"), "v")
    counts = few.groupBy("span", "v").agg(F.count(F.lit(1)).alias("n"))
    # A span holds at most FEW_ROWS rows, so its window is small.
    upto = F.sum("n").over(Window.partitionBy("span").orderBy("v"))
    ranks = [sorted({t.rank - t.below for t in members}) for members in spans.values()]
    wanted = F.get(F.array(*[F.array(*[F.lit(r).cast("bigint") for r in rs]) for rs in ranks]), F.col("span"))
    offset = F.explode(wanted).alias("offset")
    placed = counts.select("span", "v", "n", upto.alias("upto")).select("span", "v", "n", "upto", offset)
    hits = placed.where((F.col("offset") < F.col("upto")) & (F.col("offset") >= F.col("upto") - F.col("n")))
    found = {(r["span"], r["offset"]): r["v"] for r in hits.collect()}  # one row per wanted rank
    for i, members in enumerate(spans.values()):
        for t in members:
            t.value = found[i, t.rank - t.below]


def exact_quantiles(
    values: DataFrame,
    columns: Sequence[str],
    fractions: Sequence[float],
    first: Mapping[str, tuple[int, list[float] | None]] | None = None,
    few: int = FEW_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of double columns.

    NULLs are skipped; fold NaN into NULL before. ``first`` has count and sketch
    (of the fractions ``around`` the wanted ones) of each column if a scan already made them.
    """
    if first is None:
        wanted = around(fractions, accuracy)
        pairs = [F.struct(F.count(F.col(c)), sketch(F.col(c), wanted, accuracy)).alias(c) for c in columns]
        row = values.agg(*pairs).collect()[0]
        first = {c: tuple(row[c]) for c in columns}
    targets: dict[tuple[str, int], _Target] = {}
    proposed: list[_Bracket] = []
    for i, c in enumerate(columns):
        n, ends = first[c]
        for j, p in enumerate(fractions if n else ()):
            position = p * (n - 1)
            for rank in (math.floor(position), math.ceil(position)):
                if (c, rank) not in targets:
                    target = targets[c, rank] = _Target(i, rank, n)
                    if n > few:
                        proposed.append((target, *ends[2 * j : 2 * j + 2]))
    with scratch_scope(values.sparkSession):
        if proposed:
            long = _held(values, columns, list(targets.values()), proposed)
        else:
            long = _long(values, columns)
        while wide := [t for t in targets.values() if t.value is None and t.inside > few]:
            brackets = _sketched(long, wide, accuracy)
            counts = _end_counts(brackets)
            _tighten(brackets, counts, long.agg(*_aggregates(counts)).collect()[0])
        rest = [t for t in targets.values() if t.value is None]
        if rest:
            _pick(long, rest)
    result: dict[str, list[float | None]] = {}
    for c in columns:
        n = first[c][0]
        result[c] = []
        for p in fractions:
            if not n:
                result[c].append(None)
                continue
            position = p * (n - 1)
            low, high = targets[c, math.floor(position)].value, targets[c, math.ceil(position)].value
            result[c].append(low if low == high else low + (high - low) * (position - math.floor(position)))
    return result

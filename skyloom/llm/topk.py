"""Exact top-k search by inner product, by distributed histogram selection.

For a block of queries every task scores all its vectors and counts the scores in
bins. The counts of all tasks together name the bin that holds each query's k-th
score; the next pass cuts that bin into finer ones, until a bin is one integer.
A last pass keeps what is above it, and of the scores equal to it the smallest ids.
Nothing but counts moves until the k-th score is known.

A task sends of its histogram only the bins down to its own k-th score: the
k-th score of all cannot lie lower. The passes score anew, because keeping all
scores would take queries x vectors numbers on disk.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import as_table

#: Queries that are scored together; bounds what is sent to the driver and to each task.
QUERY_BLOCK = 1024
BINS = 1024
_SCORES = 4_000_000


def _vectors(batch: pa.RecordBatch, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Usable vectors of a batch by their length: ids and floor(scale * x) as doubles."""
    ids, lists = batch.column(0), batch.column(1).cast(pa.large_list(pa.float64()))
    if not len(ids):
        return {}
    offsets = np.asarray(lists.offsets)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    values = np.asarray(flat.fill_null(np.nan)) if len(flat) else np.zeros(0)
    offsets = offsets - offsets[0]
    bad = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    size = np.diff(offsets)
    ok = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (size > 0)
    ids = np.asarray(ids.fill_null(0)).astype(np.int64)
    out = {}
    for n in np.unique(size[ok]).tolist():
        rows = np.flatnonzero(ok & (size == n))
        out[n] = ids[rows], np.floor(scale * values[offsets[rows][:, None] + np.arange(n)])
    return out


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products, (queries, vectors). Sums under 2**53 are exact in doubles; others are made with
    Python's integers and held to the range of a long."""
    if np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(queries) @ whole(vectors).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _scored(batches, block: dict, scale: int):
    """Dimension, ids and score matrix of bounded pieces; a query's own row scores the least long."""
    for batch in batches:
        for n, (ids, vectors) in _vectors(batch, scale).items():
            if n not in block:
                continue
            own, queries = block[n]
            step = max(1, _SCORES // len(own))
            for at in range(0, len(ids), step):
                scores = _scores(queries, vectors[at : at + step])
                scores[own[:, None] == ids[None, at : at + step]] = np.iinfo(np.int64).min
                yield n, ids[at : at + step], scores


def _largest_norm(vectors: DataFrame, scale: int) -> float:
    def norms(batches):
        most = 0.0
        for batch in batches:
            for _, rows in _vectors(batch, scale).values():
                most = max(most, float(np.sqrt((rows**2).sum(axis=1)).max()))
        yield pa.RecordBatch.from_pydict({"norm": [most]})

    return vectors.mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0] or 0.0


def _histograms(vectors: DataFrame, shared, scale: int) -> DataFrame:
    """Counts by query and bin. Bin 0 holds the highest scores of a query's present range."""

    def count(batches):
        block, low, high, width, need = shared.value
        found = {n: np.zeros((len(own), BINS), np.int64) for n, (own, _) in block.items()}
        for n, _, scores in _scored(batches, block, scale):
            at = (scores - low[n][:, None]) // width[n][:, None]
            q, v = np.nonzero((scores >= low[n][:, None]) & (scores < high[n][:, None]))
            flat = np.bincount(q * BINS + (BINS - 1 - at[q, v]), minlength=found[n].size)
            found[n] += flat.reshape(found[n].shape)
        for n, counts in found.items():
            before = np.cumsum(counts, axis=1) - counts
            q, b = np.nonzero((counts > 0) & (before < need[n][:, None]))
            yield pa.RecordBatch.from_pydict({"dim": np.full(len(q), n), "q": q, "bin": b, "n": counts[q, b]})

    return vectors.mapInArrow(count, "dim long, q long, bin long, n long").groupBy("dim", "q", "bin").agg(F.sum("n").alias("n"))


def _thresholds(vectors: DataFrame, block: dict, k: int, scale: int, radius: float):
    """For each query the lowest score to keep, and how many of the scores equal to it (-1: all of them)."""
    sc = vectors.sparkSession.sparkContext
    low, high, width, need, left, done = {}, {}, {}, {}, {}, {}
    for n, (own, queries) in block.items():
        reach = np.ceil(np.sqrt((queries**2).sum(axis=1)) * radius) + 1
        reach = np.minimum(reach, 2.0**62).astype(np.int64)
        width[n] = reach // (BINS // 2) + 1  # BINS of them are more than 2 * reach
        low[n], high[n] = -reach, reach + 1
        need[n] = np.full(len(own), k, np.int64)
        left[n], done[n] = np.full(len(own), -1, np.int64), np.zeros(len(own), bool)
    while not all(x.all() for x in done.values()):
        shared = sc.broadcast((block, low, high, width, {n: np.where(done[n], 0, need[n]) for n in need}))
        ordered = Window.partitionBy("dim", "q").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        wanted = vectors.sparkSession.createDataFrame(
            [(n, q, int(need[n][q])) for n in need for q in np.flatnonzero(~done[n]).tolist()], "dim long, q long, need long"
        )
        bins = _histograms(vectors, shared, scale).withColumn("upto", F.sum("n").over(ordered))
        hits = bins.join(wanted, ["dim", "q"]).where("upto >= need and upto - n < need").collect()  # one row a query
        got = {(r.dim, r.q): r for r in hits}
        for n in block:
            for q in np.flatnonzero(~done[n]).tolist():
                if (r := got.get((n, q))) is None:  # fewer than k candidates: all of them
                    low[n][q], done[n][q] = np.iinfo(np.int64).min + 1, True
                    continue
                low[n][q] += (BINS - 1 - r.bin) * width[n][q]
                # Finer bins may reach past the chosen one; what lies there was taken off the need already.
                high[n][q] = min(high[n][q], low[n][q] + width[n][q])
                need[n][q] -= r.upto - r.n
                if r.n == need[n][q]:
                    done[n][q] = True
                elif width[n][q] == 1:
                    done[n][q], left[n][q] = True, need[n][q]
                else:
                    width[n][q] = -(-width[n][q] // BINS)
        shared.unpersist()
    return low, left


def _keep(vectors: DataFrame, shared, scale: int) -> DataFrame:
    def keep(batches):
        block, low, left = shared.value
        ties: dict[tuple, list] = {}
        schema = pa.schema([("dim", pa.int64()), ("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

        def rows(n, q, ids, scores):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(q), n), q, block[n][0][q], ids, scores)], schema=schema)

        for n, ids, scores in _scored(batches, block, scale):
            floor, rest = low[n][:, None], left[n][:, None]
            q, v = np.nonzero((scores > floor) | (scores == floor) & (rest < 0))
            if len(q):
                yield rows(n, q, ids[v], scores[q, v])
            for one in np.flatnonzero(((scores == floor) & (rest >= 0)).any(axis=1)).tolist():
                equal = ids[scores[one] == low[n][one]]
                ties[n, one] = np.sort(np.concatenate([ties.get((n, one), equal[:0]), equal]))[: left[n][one]]
        for (n, one), ids in ties.items():
            yield rows(n, np.full(len(ids), one), ids, np.full(len(ids), low[n][one]))

    return vectors.mapInArrow(keep, "dim long, q long, query_id long, vec_id long, score long")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block: int = QUERY_BLOCK) -> DataFrame:
    """The k vectors of highest inner product with each query: query_id, rank (from 1), vec_id, score.

    Both frames hold an id and a vector as their first two columns; others are ignored.
    Components become floor(scale * x) first. Ties go to the smaller id.

    * A null id, a null or empty vector and one with a null or non-finite component take no part.
    * Vectors of another length than the query are no candidates for it.
    * A query's candidates leave out every row that carries its id. A repeated row of
      another id is a candidate as often as it is there; equal query rows are one query.
    * Fewer than k candidates: all are returned. Empty tables give no rows.
    """
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    vectors = vectors.select(vectors.columns[:2])
    queries = queries.select(queries.columns[:2]).toDF("id", "vector").where("id is not null").dropDuplicates()
    parts = max(1, math.ceil(queries.count() / block))
    order = Window.partitionBy("dim", "q").orderBy(F.col("score").desc(), "vec_id")
    radius, results = None, []
    for part in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part) if parts > 1 else queries
        own = {}
        for batch in mine.toArrow().combine_chunks().to_batches():
            for n, (ids, rows) in _vectors(batch, scale).items():
                old = own.get(n, (ids[:0], rows[:0]))
                own[n] = np.concatenate([old[0], ids]), np.concatenate([old[1], rows])
        if not own:
            continue
        radius = _largest_norm(vectors, scale) if radius is None else radius
        low, left = _thresholds(vectors, own, k, scale, radius)
        kept = _keep(vectors, sc.broadcast((own, low, left)), scale)
        ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
        results.append(ranked if parts == 1 else as_table(ranked, "topk"))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out

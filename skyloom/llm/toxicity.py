"""Toxicity by a classifier chain: linear models in a row, each fed the earlier categories' probabilities.

A later model is trained with out-of-fold probabilities of the earlier ones: what a model
says about the rows it has learnt from is better than what it says about new rows.
Features of a text are the words, word beginnings and marks in it, hashed. Training
sees a bounded sample of the labelled rows; scoring sees all rows whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.shared import LETTER, arrow_map, bounded_sample, box_type, boxed, lower_ascii, mix, slices, text_buffer, word_bounds, word_hashes

#: Labelled rows the chain is fitted to at most.
TRAIN_ROWS = 8_000
BITS = 20
FOLDS = 3
#: Bytes of the word beginnings that are features of their own.
BEGINNINGS = (4, 5)
_WORD, _MARK = np.uint64(1), np.uint64(2)


def _features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (text, feature) pairs, in order. ``wanted`` marks the features to look at."""
    data, offsets = text_buffer(texts)
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets, LETTER[data])
    text_of = np.repeat(np.arange(n), np.diff(first))
    low, mask = lower_ascii(data), np.uint64((1 << BITS) - 1)
    found, owner = [word_hashes(low, starts, ends)], [text_of]
    for size in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > size)
        found.append(mix(word_hashes(low, starts[longer], starts[longer] + size) + np.uint64(size)))
        owner.append(text_of[longer])
    other = np.flatnonzero(~LETTER[data] & (data > 32))
    found.append(mix(data[other].astype(np.uint64) + _MARK))
    owner.append(np.searchsorted(offsets[1:], other, side="right"))
    feature, owner = (np.concatenate(found) & mask).astype(np.int64), np.concatenate(owner)
    if wanted is not None:
        keep = wanted[feature]
        feature, owner = feature[keep], owner[keep]
    pairs = np.unique(owner << BITS | feature)
    return pairs >> BITS, pairs & ((1 << BITS) - 1), n


@dataclass(frozen=True)
class Link:
    """One model of the chain: hashed features with weights, weights of the earlier log odds, and a constant."""

    feature: np.ndarray
    weight: np.ndarray
    earlier: np.ndarray
    constant: float


def _odds(link: Link, row: np.ndarray, feature: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << BITS)
    table[link.feature] = link.weight
    return link.constant + np.bincount(row, table[feature], n) + earlier @ link.earlier


def _telling(row: np.ndarray, feature: np.ndarray, y: np.ndarray, least: float = 15.0) -> np.ndarray:
    """Features whose counts in the two classes differ by a log-likelihood ratio of ``least``."""
    a = np.bincount(feature, y[row], 1 << BITS)
    both = np.bincount(feature, minlength=1 << BITS)
    b, n, share = both - a, len(y), y.sum() / max(len(y), 1)
    expected = [both * share, both * (1 - share), (n - both) * share, (n - both) * (1 - share)]
    seen = [a, b, y.sum() - a, n - y.sum() - b]
    gain = 2 * sum(np.where(s > 0, s * np.log(np.maximum(s, 1e-9) / np.maximum(e, 1e-9)), 0) for s, e in zip(seen, expected, strict=True))
    return np.flatnonzero((gain > least) & (both >= 3))


def _fit(row: np.ndarray, feature: np.ndarray, y: np.ndarray, earlier: np.ndarray, steps: int = 200, ridge: float = 1e-3) -> Link:
    """Logistic regression over the telling features, by Adam over all rows."""
    chosen = _telling(row, feature, y)
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    inside = place[feature] >= 0
    r, f = row[inside], place[feature[inside]]
    k, n = len(chosen), len(y)
    share = np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3)
    w = np.zeros(k + earlier.shape[1] + 1)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1 if 0 < y.sum() < n else 1):
        odds = w[-1] + np.bincount(r, w[f], n) + earlier @ w[k:-1]
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y
        g = np.concatenate([np.bincount(f, error[r], k), earlier.T @ error, [error.sum()]]) / n + ridge * np.append(w[:-1], 0) / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Link(chosen, w[:k], w[k:-1], float(w[-1]))


def train(ids: np.ndarray, row: np.ndarray, feature: np.ndarray, labels: np.ndarray) -> list[Link]:
    """The chain for labels (rows, categories). Folds follow the ids, so equal ids are in one fold."""
    fold = (mix(ids.astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    n, chain = len(ids), []
    earlier = np.zeros((n, 0))
    for c in range(labels.shape[1]):
        y, held_out = labels[:, c], np.zeros(n)
        for k in range(FOLDS):
            rows = np.flatnonzero(fold != k)
            new = np.full(n, -1)
            new[rows] = np.arange(len(rows))
            own = new[row] >= 0
            link = _fit(new[row[own]], feature[own], y[rows], earlier[rows])
            odds = _odds(link, row, feature, n, earlier)
            held_out[fold == k] = odds[fold == k]
        chain.append(_fit(row, feature, y, earlier))
        earlier = np.column_stack([earlier, np.clip(held_out, -8, 8)])
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], rows: int = TRAIN_ROWS) -> list[Link]:
    """Train on at most ``rows`` labelled rows, in one task. ``categories``: name -> 0/1 expression over the labels."""
    names = list(categories)
    flags = labels.select("doc_id", *(F.expr(e).cast("double").alias(n) for n, e in categories.items())).dropna()
    flags = flags.groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names))
    chosen = bounded_sample(flags.withColumn("_one", F.lit(1)), "_one", rows).select("doc_id")
    wanted = F.broadcast(flags.join(F.broadcast(chosen), "doc_id").select("doc_id", F.array(*names).alias("_labels")))

    def look(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                row, feature, n = _features(part.column("text"))
                cuts = np.searchsorted(row, np.arange(n + 1)).tolist()
                packed = [feature[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary()), part.column("_labels")], names=["doc_id", "features", "labels"])

    def learn(batches):
        got = [(i, f, y) for batch in batches for i, f, y in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)]
        got.sort(key=lambda x: (x[0], x[1]))
        got = got[:rows]  # repeated ids cannot pass the bound
        sizes = [len(f) // 4 for _, f, _ in got]
        feature = np.frombuffer(b"".join(f for _, f, _ in got), "<u4").astype(np.int64)
        y = np.array([y for _, _, y in got], float).reshape(len(got), len(names))
        chain = train(np.array([i for i, _, _ in got], np.int64), np.repeat(np.arange(len(got)), sizes), feature, y)
        yield pa.RecordBatch.from_pydict(
            {
                "place": list(range(len(chain))),
                "feature": [x.feature.astype("<i8").tobytes() for x in chain],
                "weight": [x.weight.tobytes() for x in chain],
                "earlier": [x.earlier.tobytes() for x in chain],
                "constant": [x.constant for x in chain],
            }
        )

    sample = docs.select("doc_id", "text").join(wanted, "doc_id")
    seen = arrow_map(sample, look, "doc_id long, features binary, labels array<double>")
    seen = seen.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(rows).repartition(1)
    learnt = arrow_map(seen, learn, "place long, feature binary, weight binary, earlier binary, constant double").orderBy("place").collect()
    return [Link(np.frombuffer(r.feature, "<i8"), np.frombuffer(r.weight), np.frombuffer(r.earlier), r.constant) for r in learnt]


def score(docs: DataFrame, labels: DataFrame, categories: dict[str, str], rows: int = TRAIN_ROWS) -> DataFrame:
    """All columns of docs and a probability ``p_<category>`` for each category, in the chain's order.

    A null or empty text has no features: its probabilities are those of the constants.
    Labels that are null or without a document are left out; without labels of both
    kinds a category's probability is its share (at most 0.001 if there are no labels).
    Columns named like the added ones are replaced; repeated rows are scored alike.
    """
    chain = fit(docs, labels, categories, rows)
    names = [f"p_{n}" for n in categories]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        links = shared.value
        wanted = np.zeros(1 << BITS, bool)
        for link in links:
            wanted[link.feature] = True
        for batch in batches:
            for part in slices(batch, "text"):
                row, feature, n = _features(part.column("text"), wanted)
                earlier = np.zeros((n, 0))
                for link in links:
                    earlier = np.column_stack([earlier, np.clip(_odds(link, row, feature, n, earlier), -8, 8)])
                p = 1 / (1 + np.exp(-earlier))
                yield pa.RecordBatch.from_arrays([part.column("_row"), *(pa.array(x) for x in p.T)], names=["_row", *names])

    kinds = box_type(docs, *((n, "double") for n in names))
    return arrow_map(docs.select(boxed(docs), "text"), run, kinds).select("_row.*", *names)

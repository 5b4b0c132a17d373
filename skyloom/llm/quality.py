"""Quality rules: word statistics of whole texts, base rules, and boosted trees over the statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import forest
from skyloom.llm.shared import bounded_sample, line_bounds, mix, slices, text_buffer, word_bounds, word_hashes

#: Labelled rows that the trees are fitted to at most; which ones depends on their ids only.
TRAIN_ROWS = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Odds of being kept may only fall with the share of symbols, repeated lines and repeated words.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0, "digit_share": 0, "mark_share": 0, "stop_share": 0, "line_words": 0, "single_share": 0}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _kind(spec: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(spec.encode())] = True
    return out


_UPPER, _DIGIT, _MARK = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("0123456789"), _kind("!?.,;:'\"()-")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether its text holds it elsewhere too, and whether before."""
    order = np.lexsort((keys, text))
    same = (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])
    later, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return shared, later


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts, and the features of the trees, of every text."""
    data, offsets = text_buffer(texts)
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    n_words = np.diff(first)
    text_of = np.repeat(np.arange(n), n_words)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = lead[ends] - lead[starts]
    per_word = lambda values: np.bincount(text_of, values, n).astype(np.int64)
    hashes = word_hashes(data, starts, ends)

    # Windows of three words within one text.
    covered = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        begin = np.flatnonzero(text_of[2:] == text_of[:-2])
        keys = mix(mix(mix(hashes[begin]) + hashes[begin + 1]) + hashes[begin + 2])
        twice = begin[_again(keys, text_of[begin])[0]]
        for k in range(3):
            covered[twice + k] = True

    # Lines that hold a word; a line is its bytes.
    line_start, line_end, line_text = line_bounds(data, offsets)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_text = line_start[worded], line_end[worded], line_text[worded]
    dup = np.zeros(0, bool)
    if len(line_start):
        dup = _again(word_hashes(data, line_start, line_end), line_text)[1]
    n_lines, n_dup = np.bincount(line_text, minlength=n), np.bincount(line_text, dup, n)

    counts = {
        "n_words": n_words,
        "word_chars": per_word(chars),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": n_dup.astype(np.int64),
        "n_repeat_words": per_word(covered),
    }
    size = np.maximum(counts["word_chars"], 1)
    words = np.maximum(n_words, 1)
    short = per_word(chars <= 3)
    features = np.stack(
        [
            np.log1p(n_words),
            counts["word_chars"] / words,
            counts["n_symbols"] / words,
            n_dup / np.maximum(n_lines, 1),
            counts["n_repeat_words"] / words,
            _per_text(_UPPER[data], offsets) / size,
            _per_text(_DIGIT[data], offsets) / size,
            _per_text(_MARK[data], offsets) / size,
            short / words,
            n_words / np.maximum(n_lines, 1),
            per_word(chars == 1) / words,
        ],
        axis=1,
    )
    return counts, features


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> forest.Forest | None:
    """Trees that tell quality 1 from 0, from at most ``rows`` labelled rows chosen by a hash of their ids; equal rows are one."""
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(bounded_sample(labels, "quality", rows)), "doc_id")
    names = [f"f{i}" for i in range(len(FEATURES))]
    kinds = ", ".join(f"{n} double" for n in [*names, "y"])

    def measure(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                features = statistics(part.column("text"))[1]
                columns = [part.column("doc_id"), *(pa.array(f, pa.float64()) for f in features.T), part.column("y")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "y"])

    # Repeated rows count once; texts that share an id beyond the bound are left out by the hash of the id, whatever their label.
    measured = sample.select("doc_id", "text", "y").mapInArrow(measure, "doc_id long, " + kinds).distinct()
    found = measured.orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(rows).toArrow()
    if not found.num_rows:
        return None
    columns = [found.column(c).to_numpy() for c in names]
    return forest.train(np.stack(columns, axis=1), found.column("y").to_numpy(), list(FEATURES.values()))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """Counts, base rules and verdict for every document: doc_id, the five counts, base_failed, quality, kept.

    Words are runs of characters other than space and \\x09-\\x0D. A null text has no
    words. base_failed: fewer than 50 words, or over half of them in 3-word windows that
    the text holds twice or more. kept: base rules passed, and the trees give a
    probability of good quality of at least ``threshold`` (without labels of both kinds
    the trees hold no splits and keep). Repeated rows are judged alike; an empty
    table gives no rows. Extra columns are ignored.
    """
    model = train(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("quality", pa.float64()), ("kept", pa.bool_())])

    def measure(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                counts, features = statistics(part.column("text"))
                failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
                quality = shared.value.probability(features) if shared.value is not None else np.ones(len(failed))
                columns = [part.column("doc_id"), *(counts[c] for c in COUNTS), failed, quality, ~failed & (quality >= threshold)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, quality double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(measure, kinds)

"""Language identification by fusing evidence: text, declared language, address suffix and host.

log P(language | all) = text likelihood + declared language + prior of the host, plus a
constant. The text model is a naive Bayes over hashed letter trigrams, counted over all
texts by their declared language. A host's prior is smoothed towards that of its
address suffix, and that one towards the whole table; all are grouped counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.shared import LETTER, arrow_map, box_type, boxed, lower_ascii, mix, slices, text_buffer
from skyloom.session import as_table

#: Trigrams are counted in so many buckets.
BUCKETS = 1 << 14
#: Numbers of the text model, languages x BUCKETS, that driver and tasks may hold (128 MB). More is an error, not a choice of languages.
MODEL_CELLS = 1 << 24
#: How often a declared language is right.
TRUST = 0.9
#: Rows that a suffix's or host's parent prior counts for.
PARENT_ROWS = 20.0
#: The trigrams of one text are not independent: it counts as so many at most.
EVIDENCE = 100.0


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and text of every trigram around a letter; everything but letters reads as a space."""
    data, offsets = text_buffer(texts)
    n = len(offsets) - 1
    plain = np.where(LETTER[data], lower_ascii(data), 32).astype(np.uint64)
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.concatenate([[np.uint64(32)], plain, [np.uint64(32)]])
    edge = np.concatenate([[True], text_of[1:] != text_of[:-1], [True]]) if len(plain) else np.ones(1, bool)
    before = np.where(edge[:-1], np.uint64(32), padded[:-2])
    after = np.where(edge[1:], np.uint64(32), padded[2:])
    ok = plain != 32
    codes = (before[ok] << np.uint64(16)) | (plain[ok] << np.uint64(8)) | after[ok]
    return (mix(codes) & np.uint64(BUCKETS - 1)).astype(np.int64), text_of[ok], n


def _text_model(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """log P(bucket | language), (buckets, languages)."""
    index = {name: i for i, name in enumerate(languages)}

    def count(batches):
        found = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                codes, text_of, _ = _trigrams(part.column("_text"))
                language = np.array([index.get(x, -1) for x in part.column("_declared").to_pylist()], np.int64)[text_of]
                found += np.bincount((language * BUCKETS + codes)[language >= 0], minlength=len(found))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"at": at, "n": found[at]})

    total = np.zeros(len(languages) * BUCKETS)
    counted = arrow_map(rows.select("_text", "_declared"), count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # languages x buckets at most
    total[got.column("at").to_numpy()] = got.column("n").to_numpy()
    total = total.reshape(len(languages), BUCKETS)
    total += 0.5
    total /= total.sum(axis=1, keepdims=True)
    return np.log(total, out=total).T.copy()


def _said(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """For each key the codes of its declared languages and their rows, in two arrays of one order."""
    sums = counts.where("_code is not null").groupBy(*keys, "_code").agg(F.sum("_n").alias("n"))
    pairs = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_code", "n"))).alias("p"))
    return pairs.select(*(F.col(k).alias(name + k) for k in keys), F.col("p._code").alias(f"{name}_code"), F.col("p.n").alias(f"{name}_n"))


def _smoothed(codes: pa.Array, counts: pa.Array, parent: np.ndarray) -> np.ndarray:
    """P(language | key) of each row, with the parent's probability for PARENT_ROWS rows more. Rows without counts have the parent's."""
    own = np.zeros(parent.shape)
    row = np.repeat(np.arange(len(own)), np.asarray(pc.fill_null(pc.list_value_length(codes), 0)))
    own[row, np.asarray(codes.flatten())] = np.asarray(counts.flatten())
    total = own.sum(axis=1, keepdims=True)
    return np.where(total > 0, (own + PARENT_ROWS * parent) / (total + PARENT_ROWS), parent)


def identify(docs: DataFrame, text: str, declared: str | None = None, suffix: str | None = None, host: str | None = None) -> DataFrame:
    """Add language, posterior and language_accepted to every row (columns of these names are replaced).

    ``declared``, ``suffix`` and ``host`` name columns or are left out. Every language that
    some row declares is told apart, however rare; more than MODEL_CELLS allows are an error.
    A null declared language, a null suffix and a null host are no evidence. A text without letters
    (null and empty too) has no language and is not accepted; nor is one whose
    posterior is under one half. Repeated rows get the same answer. Without any declared
    language nothing is known, so all rows are without language.
    """
    part = {"_text": text, "_declared": declared, "_suffix": suffix, "_host": host}
    added = ["language", "posterior", "language_accepted"]
    bare = docs.drop(*added)
    evidence = [(F.col(f"`{v}`") if v else F.lit(None)).cast("string").alias(k) for k, v in part.items()]
    rows = docs.select(boxed(bare), *evidence)
    counts = rows.groupBy("_host", "_suffix", "_declared").agg(F.count("*").alias("_n"))
    # Hosts are many; their counts are written once and read for each level.
    counts = as_table(counts, "language-counts")
    declares = counts.where("_declared is not null").groupBy("_declared").agg(F.sum("_n").alias("n"))
    most = MODEL_CELLS // BUCKETS
    languages = {r[0]: r[1] for r in declares.limit(most + 1).collect()}
    if len(languages) > most:
        raise ValueError(f"More than {most} declared languages: the text model would not fit. Clean the declared column, or raise MODEL_CELLS.")
    if not languages:
        return bare.withColumns({"language": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"), "language_accepted": F.lit(False)})
    names = sorted(languages)
    every = [languages[x] / sum(languages.values()) for x in names]
    model = rows.sparkSession.sparkContext.broadcast(_text_model(rows, names))

    codes = rows.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "_declared string, _code int")
    coded = counts.join(F.broadcast(codes), "_declared", "left")
    h = as_table(_said(coded.where("_host is not null"), ["_host", "_suffix"], "h"), "host-languages")
    s = as_table(_said(coded, ["_suffix"], "s"), "suffix-languages")
    joined = rows.join(h, (F.col("_host") == F.col("h_host")) & F.col("_suffix").eqNullSafe(F.col("h_suffix")), "left")
    joined = joined.join(s, F.col("_suffix").eqNullSafe(F.col("s_suffix")), "left")
    ready = joined.select("_row", "_text", "_declared", "h_code", "h_n", "s_code", "s_n")

    def fuse(batches):
        logs, index = model.value, {name: i for i, name in enumerate(names)}
        miss = np.log((1 - TRUST) / max(1, len(names) - 1)) if len(names) > 1 else 0.0
        for batch in batches:
            for part in slices(batch, "_text"):
                codes, text_of, n = _trigrams(part.column("_text"))
                seen = np.bincount(text_of, minlength=n)
                score = np.stack([np.bincount(text_of, logs[codes, i], n) for i in range(len(names))], axis=1).astype(float)
                score *= (np.minimum(seen, EVIDENCE) / np.maximum(seen, 1))[:, None]
                prior = np.tile(np.array(every), (n, 1))
                for level in "sh":
                    prior = _smoothed(part.column(f"{level}_code"), part.column(f"{level}_n"), prior)
                score += np.log(prior)
                said = np.array([index.get(x, -1) for x in part.column("_declared").to_pylist()], np.int64)
                known = np.flatnonzero(said >= 0)
                score[known] += miss
                score[known, said[known]] += np.log(TRUST) - miss
                best = score.argmax(axis=1)
                p = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
                none = seen == 0
                out = [part.column("_row")]
                out.append(pa.array(np.array(names, object)[best], pa.string(), mask=none))
                out.append(pa.array(p, pa.float64(), mask=none))
                out.append(pa.array(~none & (p >= 0.5)))
                yield pa.RecordBatch.from_arrays(out, names=["_row", *added])

    kinds = box_type(bare, ("language", "string"), ("posterior", "double"), ("language_accepted", "boolean"))
    return arrow_map(ready, fuse, kinds).select("_row.*", *added)

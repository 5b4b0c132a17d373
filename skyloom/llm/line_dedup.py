"""Line deduplication: repeated runs of lines by prefix doubling over line identifiers.

Lines become identifiers; the suffixes of the sequences of all documents are named by
their first line, then by their first 2, 4, 8 ... lines: a name of 2k lines is made of
the names at a position and k lines on. Suffixes with one name are an interval of the
suffix array whose common prefix has at least that many lines. Names stand in for ranks:
which interval comes first never matters, so no global sort is made.

Only lines that occur twice take part, and of them only stretches long enough for a run.
A run is repeated if the shortest stretch of ``min_words`` words from its start, or up to
its end, is. A maximal repeated run is a union of such stretches (each of its lines is
in one), so two names for each line find all of it; no longer prefix is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.shared import arrow_map, boxed, line_bounds, mix, slices, text_buffer, word_bounds, word_hashes
from skyloom.session import as_table

#: A run of lines must have so many words to count as repeated.
MIN_WORDS = 50
_DOC = ["_d", "_t"]


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row for each line with a word: document, place among them, two hashes, words, how many lines the shortest run
    of ``min_words`` words from (_f) or up to (_b) this line has (0: none), and its lines in the text with blank ones after it."""
    names = ["_d", "_t", "_at", "_x", "_y", "_words", "_f", "_b", "_lo", "_hi"]

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                starts, ends, text_of = line_bounds(data, offsets)
                first, last, _ = word_bounds(data, offsets)
                words = np.searchsorted(first, ends) - np.searchsorted(first, starts)
                number = np.arange(len(starts)) - np.searchsorted(text_of, text_of)
                total = np.bincount(text_of, minlength=part.num_rows)
                kept = np.flatnonzero(words > 0)
                if not len(kept):
                    continue
                starts, ends, text_of, words, number = (x[kept] for x in (starts, ends, text_of, words, number))
                begin = np.searchsorted(text_of, text_of)
                at = np.arange(len(kept)) - begin
                following = np.append(number[1:], 0)
                final = np.append(text_of[1:] != text_of[:-1], True)
                following[final] = total[text_of[final]]
                upto = np.concatenate([[0], np.cumsum(words)])
                end = np.searchsorted(upto, upto[:-1] + min_words)  # lines up to here hold the words
                stop = np.searchsorted(text_of, text_of, side="right")
                f = np.where(end <= stop, end - np.arange(len(kept)), 0)
                start = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
                b = np.where((upto[1:] >= min_words) & (start >= begin), np.arange(len(kept)) + 1 - start, 0)
                docs_of = pa.array(text_of)
                columns = [part.column("_d").take(docs_of), part.column("_t").take(docs_of), at]
                columns += [word_hashes(data, starts, ends, seed).view(np.int64) for seed in (0, 1)]
                columns += [words, f, b, number, following]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    return arrow_map(docs.select("_d", "_t", "text"), cut, ", ".join(f"{n} long" for n in names))


def _repeated(named: DataFrame, key: list[str], place: list[str]) -> DataFrame:
    """Keys at two places at least, with the first place."""
    first = named.groupBy(*key).agg(F.min(F.struct(*place)).alias("_first"), F.max(F.struct(*place)).alias("_last"))
    return first.where(F.col("_first") != F.col("_last")).drop("_last")


def _doubled(x: np.ndarray, room: np.ndarray, levels: int) -> list[np.ndarray]:
    """Names of the 2**k lines from each place on, for each k; ``room``: how many lines its stretch still has."""
    names = [x]
    for k in range(1, levels):
        half = 1 << (k - 1)
        ahead = np.append(names[-1][half:], np.zeros(min(half, len(x)), np.uint64))
        names.append(np.where(room >= 2 * half, mix(mix(names[-1] + np.uint64(k)) + ahead), 0))
    return names


def _runs(active: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of ``min_words`` words from and up to each line, all of whose lines occur twice, with a
    128-bit name of their lines: _k, _l, document, _at, _lo, _hi, _m (lines)."""
    fields = ["_at", "_x", "_y", "_f", "_b", "_lo", "_hi"]
    stretches = active.groupBy(*_DOC).agg(F.collect_set(F.struct(*fields)).alias("_lines"))  # bounded by one text
    out = ["_k", "_l", *_DOC, "_at", "_lo", "_hi", "_m"]

    def name(batches):
        for batch in batches:
            lists = batch.column("_lines")
            flat = lists.flatten()
            column = {f: np.asarray(flat.field(f)) for f in fields}
            doc = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            order = np.lexsort((column["_at"], doc))
            column, doc = {f: v[order] for f, v in column.items()}, doc[order]
            at, n = column["_at"], len(doc)
            # First and last line of the stretch that each line is in.
            cut = np.flatnonzero((doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)) + 1
            edges = np.concatenate([[0], cut, [n]])
            stretch = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            place = np.arange(n)
            room, behind = edges[stretch + 1] - place, place - edges[stretch] + 1
            forward, backward = column["_f"], column["_b"]
            begin = np.concatenate([place[(forward > 0) & (forward <= room)], (place - backward + 1)[(backward > 0) & (backward <= behind)]])
            size = np.concatenate([forward[(forward > 0) & (forward <= room)], backward[(backward > 0) & (backward <= behind)]])
            both = np.unique(np.stack([begin, size]), axis=1)
            begin, size = both[0], both[1]
            if not len(begin):
                continue
            levels = int(size.max()).bit_length()
            level = np.floor(np.log2(size)).astype(np.int64)
            tail = begin + size - (1 << level)
            keys = []
            for c in ("_x", "_y"):
                names = np.stack(_doubled(column[c].view(np.uint64), room, levels))
                keys.append(mix(mix(mix(names[level, begin]) + names[level, tail]) + size.astype(np.uint64)).view(np.int64))
            owner = pa.array(doc[begin])
            last = begin + size - 1
            columns = [*keys, batch.column("_d").take(owner), batch.column("_t").take(owner), at[begin], column["_lo"][begin], column["_hi"][last], size]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if isinstance(c, np.ndarray) else c for c in columns], names=out)

    return arrow_map(stretches, name, ", ".join(f"{c} long" for c in out))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies, one row a document: _d, _t, _spans (ranges _lo to _hi of \\n-split lines) and _n (lines with a word).

    ``docs``: _d, _t and text. Places are ordered by _d, _t and line; the first copy of a run stays.
    """
    place = [*_DOC, "_at"]
    lines = as_table(_lines(docs, min_words), "lines")
    twice = _repeated(lines, ["_x", "_y"], place).drop("_first")
    runs = as_table(_runs(lines.join(twice, ["_x", "_y"]), min_words), "line-runs")
    first = _repeated(runs, ["_k", "_l"], place)
    later = runs.join(first, ["_k", "_l"]).where(F.struct(*place) > F.col("_first"))
    # Runs that touch or overlap become one span.
    ordered = Window.partitionBy(*_DOC).orderBy("_at")
    before = F.max(F.col("_at") + F.col("_m")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("_at") <= before, 0).otherwise(1)
    island = F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    spans = later.withColumn("_new", starts).withColumn("_island", island).groupBy(*_DOC, "_island")
    size = F.max(F.col("_at") + F.col("_m")) - F.min("_at")
    spans = spans.agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), size.alias("_n"))
    return spans.groupBy(*_DOC).agg(F.collect_list(F.struct("_lo", "_hi")).alias("_spans"), F.sum("_n").alias("_n"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Delete later copies of repeated line runs from the texts; adds removed_lines and emptied.

    Takes doc_id and text; all other columns stay (one named removed_lines or emptied is
    replaced). A line is what stands between \\n; one without a word goes with the line
    before it. A line is deleted if it is in a run of lines of one text that has at least
    ``min_words`` words and begins earlier somewhere else too, in the order of doc_id,
    then text hash, then line (an overlapping copy in the same text counts).

    * Rows equal in doc_id and text count as one document and are edited alike.
    * A null doc_id comes before all others. A null text stays null, an empty one empty.
    * emptied: lines were removed and none with a word is left. removed_lines: lines with a word.
    """
    docs = docs.drop("removed_lines", "emptied")
    least = F.lit(-(2**63)).cast("long")
    marked = docs.select(boxed(docs), F.coalesce("doc_id", least).alias("_d"), F.xxhash64("text").alias("_t"), "text")
    spans = repeated_lines(marked.select("_d", "_t", "text"), min_words)
    joined = marked.join(spans.hint("shuffle_hash"), _DOC, "left")
    gone = lambda i: F.exists("_spans", lambda s: (i >= s["_lo"]) & (i < s["_hi"]))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~gone(i)), "\n")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(left)
    removed = F.coalesce("_n", F.lit(0)).cast("long")
    others = [F.col(f"_row.`{c}`") if c != "text" else text.alias("text") for c in docs.columns]
    out = joined.select(*others, removed.alias("removed_lines"))
    return out.withColumn("emptied", (F.col("removed_lines") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))

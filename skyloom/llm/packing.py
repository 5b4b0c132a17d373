"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

The plan is made over counts, never over documents: best fit in decreasing order of
length, where all open sequences with the same free space are one or a few ranges of
sequence numbers. It has a few rows for each length, however many documents there are.
Pieces then take the planned slots by their rank within their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.shared import arrow_map, boxed, slices
from skyloom.llm.word_bpe import encoder
from skyloom.session import as_table

CAPACITY = 2048
#: Rows of one length that are ranked together.
RANKED_TOGETHER = 500


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Token ids of whole texts, cut only where longer than ``capacity``.

    Takes doc_id and text; returns doc_id, piece (from 0), start, length and ids
    (little-endian unsigned 32-bit). The end id follows the ids of every text, so a
    null or empty text is one piece of one id. Repeated rows give repeated pieces.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches):
        table, words = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = table.ids([words.pieces(t or "") for t in part.column("text").to_pylist()])
                rows = []
                for doc, begin, end in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4").tobytes()
                    for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                        one = own[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(one) // 4, one))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return arrow_map(docs.select("doc_id", "text"), cut, "doc_id long, piece int, start long, length long, ids binary")


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts. Rows (length, first_rank, n, each, first_sequence, offset): ranks first_rank up to
    first_rank + n of that length go ``each`` to a sequence, from first_sequence on, at offset and then side by side."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free space: (first sequence, how many)
    slots, used = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for space in [*range(length, capacity), capacity]:
            each = space // length
            while left and (free[space] or space == capacity):
                if free[space]:
                    first, many = free[space].pop()
                else:
                    first, many = used, -(-left // each)
                    used += many
                full = min(many, left // each)
                if full:
                    slots.append((length, rank, full * each, each, first, capacity - space))
                    free[space - each * length].append((first, full))
                    rank, left = rank + full * each, left - full * each
                if full < many and left:  # the last of them
                    slots.append((length, rank, left, each, first + full, capacity - space))
                    free[space - left * length].append((first + full, 1))
                    full, rank, left = full + 1, rank + left, 0
                if full < many:
                    free[space].append((first + full, many - full))
            if not left:
                break
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a sequence and a place in it: adds sequence_id and offset to all columns.

    Takes doc_id, piece and length (1 to ``capacity``) besides any others; columns named
    like the added ones are replaced. Sequences are filled from 0 without gaps. Equal rows
    each get a place of their own. No pieces give no rows.
    """
    spark = pieces.sparkSession
    given = pieces.drop("sequence_id", "offset")
    pieces = as_table(given.select(boxed(given), "doc_id", "piece", "length"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row a length
    if not counts:
        return pieces.select("_row.*").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    parts = spark.createDataFrame([(n, -(-c // RANKED_TOGETHER)) for n, c in counts.items()], "length long, _parts long")
    slots = spark.createDataFrame(plan_slots(counts, capacity), "length long, _first long, _n long, _each long, _sequence long, _offset long")

    salted = pieces.join(F.broadcast(parts), "length").withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), "_parts")).drop("_parts")
    sizes = salted.groupBy("length", "_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("_local", local).join(bases, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_local"))
    at = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(slots), "length").where((at >= 0) & (at < F.col("_n")))
    return placed.select(
        "_row.*",
        (F.col("_sequence") + ((at - at % F.col("_each")) / F.col("_each")).cast("long")).alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).alias("offset"),
    )

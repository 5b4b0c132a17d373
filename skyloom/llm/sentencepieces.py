"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model crosses from text into a following whitespace marker, so a text
falls apart before every run of markers. Each distinct marked word is segmented once in
a worker, and a text takes the ids of its words by position. The table is per worker:
one for the whole corpus would have to shuffle every word of every text.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm.chunks import ChunkTable, flat
from skyloom.llm.shared import slices

_MARKER = "▁"
_RUN = re.compile(r" *[^ ]+| +$")


def _words(text: str) -> list[str]:
    """Marked words of a text. A word stands for its markers but one (the library adds that one itself)
    and its characters; '' is a single marker at the end of a text."""
    if not text:
        return []
    text = text.replace(_MARKER, " ")  # the library takes both for the marker
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    # The marker before the first word is the one the library puts before a text.
    return [run[1:] for run in _RUN.findall(" " + text)]


class _Segmenter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.marker = self.model.piece_to_id(_MARKER)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        if any(_MARKER in p.lstrip(_MARKER) for p in pieces) or self.model.encode("a") != self.model.encode(["a"])[0]:
            raise ValueError("The model has pieces that cross a whitespace marker; its words cannot be encoded one by one.")
        if self.model.encode("a  b ", out_type=str)[0] != _MARKER + "a":
            raise ValueError("The model does not put a whitespace marker before a text.")

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(words, num_threads=1)
        return flat([ids if word else [self.marker] for word, ids in zip(words, found, strict=True)])


@cache
def _table(path: str) -> tuple[ChunkTable, _Segmenter]:
    segmenter = _Segmenter(path)
    return ChunkTable(segmenter), segmenter


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """Ids of every whole text, and the text that the library decodes them to.

    Takes doc_id and text; returns doc_id, n_tokens (begin and end ids counted), ids
    (little-endian unsigned 32-bit) and decoded. A null or empty text is the begin and
    the end id and decodes to the empty text. Repeated rows are repeated.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        table, segmenter = _table(model_path)
        ends = [np.array([i], "<u4") for i in (segmenter.model.bos_id(), segmenter.model.eos_id())]
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                ids, first = table.ids([_words(t or "") for t in part.column("text").to_pylist()])
                each = [np.concatenate([ends[0], ids[a:b], ends[1]]).astype("<u4") for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                decoded = segmenter.model.decode([x.tolist() for x in each], num_threads=1)
                columns = part.column("doc_id"), [len(x) for x in each], [x.tobytes() for x in each], decoded
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")

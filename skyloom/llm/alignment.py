"""Alignment of two tokenizers over the same bytes, and corpus-wide counts of linked id pairs.

Tokens of both sides are intervals of one byte string, so two sorted lists of end offsets say
everything. From a common end on, tokens of equal shape keep one difference of positions (a
diagonal): exponential probing compares ever longer slices of both lists along it and jumps over
the whole one-to-one stretch. Where the slices part, the shorter side steps forward until both
ends meet again; that is an irregular group, and it sets the diagonal of the next stretch.

Linked pairs are counted in blocks: a task numbers the distinct pairs of some megabytes of text,
sends one row for each (with the number of documents that hold it), and keeps a document as
numbers. What comes back is one row a block, so the pairs of documents never travel one by one.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.shared import slices
from skyloom.session import as_table

#: Stands for the ids of a chunk whose tokens do not spell it.
_UNSPELLED = 2**32 - 1
#: Bytes of text whose linked pairs are numbered together; a longer document is a block of its own.
BLOCK_BYTES = 4_000_000
#: Bytes, about, of a worker's table of chunks, and of a chunk in it besides its characters.
MOST_BYTES, _OVERHEAD = 64_000_000, 200
#: Chunks that a tokenizer is given as one text.
_TOGETHER = 64
_MARKER = "▁"
_GAP = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def chunks(text: str) -> list[str]:
    """The parts of space + text that no token of either side crosses, each without its first space.

    A token holds a space only as its first character or in a run of white space, so a space
    after something else always begins a token.
    """
    text = " " + text
    if _GAP.search(text) is None:
        return text[1:].split(" ")
    return [part[1:] for part in _CUT.split(text)]


def byte_alphabet() -> dict[str, int]:
    """Character of byte-level vocabularies -> byte: printable ones of Latin-1 stand for themselves, the rest follow from U+0100 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}


class _Side:
    """One tokenizer: the bytes of every id, and how it segments chunks."""

    def __init__(self, pieces: list[bytes], encode):
        self.pieces, self._encode = pieces, encode
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))

    def segment(self, waiting: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in a row, and how many each has; a chunk that they do not spell is the one id _UNSPELLED."""
        found = self._joined(waiting) if all(c and _MARKER not in c and not c[-1].isspace() for c in waiting) else None
        if found is None:
            each = self._encode(waiting)
            spelled = (b"".join([self.pieces[i] for i in ids]) == b" " + chunk.encode() for ids, chunk in zip(each, waiting, strict=True))
            each = [ids if ok else [_UNSPELLED] for ids, ok in zip(each, spelled, strict=True)]
            found = np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        return found

    def _joined(self, waiting: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for chunks that end in something else than white space: many at a time, cut at the known bytes."""
        texts = [" ".join(waiting[at : at + _TOGETHER]) for at in range(0, len(waiting), _TOGETHER)]
        ids = list(chain.from_iterable(self._encode(texts)))
        if b"".join([self.pieces[i] for i in ids]) != "".join([" " + t for t in texts]).encode():
            return None
        ids = np.array(ids, np.uint32)
        ends = np.cumsum(self.sizes[ids])
        cuts = np.cumsum([1 + (len(c) if c.isascii() else len(c.encode())) for c in waiting])
        last = np.searchsorted(ends, cuts)
        return (ids, np.diff(last, prepend=-1)) if (ends[last] == cuts).all() else None


def _byte_level(path: str) -> _Side:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    alphabet = byte_alphabet()
    special = {t["id"]: t["content"] for t in json.loads(tokenizer.to_str())["added_tokens"]}
    pieces = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        pieces[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
    return _Side(pieces, lambda waiting: [e.ids for e in tokenizer.encode_batch_fast([" " + c for c in waiting], add_special_tokens=False)])


def _sentence_pieces(path: str) -> _Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    marker = model.piece_to_id(_MARKER)
    pieces = []
    for i in range(model.vocab_size()):
        name = model.id_to_piece(i)
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", name) if model.is_byte(i) else None
        pieces.append(bytes([int(byte[1], 16)]) if byte else name.replace(_MARKER, " ").encode())
    return _Side(pieces, lambda waiting: [ids if chunk else [marker] for ids, chunk in zip(model.encode(waiting, num_threads=1), waiting, strict=True)])


class _Numbers(dict):
    """Chunk -> its number; a new chunk waits to be segmented."""

    def __init__(self):
        self.waiting, self.held = [], 0

    def __missing__(self, chunk):
        number = self[chunk] = len(self)
        self.waiting.append(chunk)
        self.held += _OVERHEAD + len(chunk)
        return number


class _Both:
    """Both tokenizers of a worker, and its table of distinct chunks, each segmented once. The table is emptied at MOST_BYTES."""

    def __init__(self, sides: tuple[_Side, _Side]):
        self.sides = sides
        self._clear()

    def _clear(self):
        self._numbers, self._known = _Numbers(), [[np.zeros(0, np.uint32)] * 2 + [np.zeros(0, np.int64)] for _ in self.sides]

    def _learn(self):
        """Ids, and of each chunk how many and where they begin."""
        waiting, self._numbers.waiting = self._numbers.waiting, []
        plain = [bool(c) and _MARKER not in c and not c[-1].isspace() for c in waiting]
        order = sorted(range(len(waiting)), key=lambda k: not plain[k])
        split = sum(plain)
        for side, known in zip(self.sides, self._known, strict=True):
            parts = [side.segment([waiting[k] for k in own]) for own in (order[:split], order[split:]) if own]
            ids, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            own = np.empty(len(waiting), np.int64)
            own[order] = len(known[0]) + np.cumsum(sizes) - sizes
            count = np.empty(len(waiting), np.uint32)
            count[order] = sizes
            known[:] = np.concatenate([known[0], ids]), np.concatenate([known[1], count]), np.concatenate([known[2], own])

    def ids(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of either side the ids of all texts in a row, and where each text begins (n + 1)."""
        if self._numbers.held > MOST_BYTES:
            self._clear()
        numbers = np.fromiter(map(self._numbers.__getitem__, chain.from_iterable(texts)), np.int64)
        if self._numbers.waiting:
            self._learn()
        cuts, out = np.cumsum([0, *map(len, texts)]), []
        for pool, size, start in self._known:
            per = size[numbers].astype(np.int64)
            first = np.concatenate([[0], np.cumsum(per)])
            out.append((pool[np.arange(first[-1]) + np.repeat(start[numbers] - first[:-1], per)], first[cuts]))
        return out


@cache
def _both(byte_path: str, piece_path: str) -> _Both:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _Both((_byte_level(byte_path), _sentence_pieces(piece_path)))


def irregular(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Groups of more than one token on a side, between two lists of end offsets that close with one last end: the
    first token of A, and how many of A and of B. Everything between them is one to one."""
    begins, tokens_a, tokens_b = [], [], []
    i, j, last_a, last_b = 0, 0, len(ends_a), len(ends_b)
    while i < last_a:
        x, y = ends_a[i], ends_b[j]
        if x == y:  # a diagonal: probe along it, twice as far each time, then closer
            i, j = i + 1, j + 1
            step = min(2, last_a - i, last_b - j)
            while step and ends_a[i : i + step] == ends_b[j : j + step]:
                i, j = i + step, j + step
                step = min(2 * step, last_a - i, last_b - j)
            while step > 1:
                step //= 2
                if ends_a[i : i + step] == ends_b[j : j + step]:
                    i, j = i + step, j + step
            continue
        begin, other = i, j
        while x != y:  # the side that is behind steps on; where both meet, the next diagonal begins
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        i, j = i + 1, j + 1
        begins.append(begin)
        tokens_a.append(i - begin)
        tokens_b.append(j - other)
    return begins, tokens_a, tokens_b


def group_sizes(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in every group, in order."""
    begins, n, m = (np.array(x, np.int64) for x in irregular(ends_a.tolist(), ends_b.tolist()))
    before = begins - np.concatenate([[0], np.cumsum(n)[:-1]])[: len(n)]  # one-to-one groups before each
    at = before + np.arange(len(n))
    groups = len(ends_a) - int(n.sum()) + len(n)
    out = np.ones((2, groups), np.int64)
    out[:, at] = n, m
    return out[0], out[1]


class _Aligned:
    """Some texts in a row: ids a and b, their ends in the bytes of all texts, first token of each text, and the
    groups: how many tokens of either side each has, and the first group of each text."""

    def __init__(self, texts: list, both: _Both):
        whole = [chunks(t) if t else [] for t in texts]
        found = both.ids(whole)
        bad = {int(np.searchsorted(first, k, side="right")) - 1 for ids, first in found for k in np.flatnonzero(ids == _UNSPELLED)}
        if bad:
            found = both.ids([[] if k in bad else w for k, w in enumerate(whole)])
        (self.a, self.first_a), (self.b, self.first_b) = found
        self.a, self.b = self.a.astype(np.int64), self.b.astype(np.int64)
        self.ends_a, self.ends_b = (np.cumsum(side.sizes[ids]) for side, ids in zip(both.sides, (self.a, self.b), strict=True))
        self.group_a, self.group_b = group_sizes(self.ends_a, self.ends_b)
        self.first_group = np.searchsorted(np.cumsum(self.group_a), self.first_a, side="right")
        self.first_group[self.first_a == len(self.a)] = len(self.group_a)

    def spelled(self) -> list[bytes]:
        """Of each text its groups, `a1,a2|b1;a3|b2`."""
        after_a, after_b = np.cumsum(self.group_a), np.cumsum(self.group_b)
        at_a = np.arange(len(self.a)) + np.repeat(after_b - self.group_b, self.group_a)
        at_b = np.arange(len(self.b)) + np.repeat(after_a, self.group_b)
        ids, mark = np.empty(len(at_a) + len(at_b), np.int64), np.full(len(at_a) + len(at_b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        mark[at_a[after_a - 1]], mark[at_b[after_b - 1]] = ord("|"), ord(";")
        digits = np.ones(len(ids), np.int64)
        for power in range(1, 10):
            digits += ids >= 10**power
        end = np.cumsum(digits + 1)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        out[end - 1] = mark
        for power in range(int(digits.max(initial=0))):
            some = digits > power
            out[end[some] - 2 - power] = ord("0") + ids[some] // 10**power % 10
        cuts = np.concatenate([[0], end])[self.first_a + self.first_b].tolist()
        whole = out.tobytes()
        return [whole[p : max(p, q - 1)] for p, q in zip(cuts[:-1], cuts[1:], strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and id pair (a << 32 | b) of every two tokens whose bytes overlap. The overlap lies between two
        neighbouring ends of both sides together, and each such stretch of bytes has one token of either side."""
        ends = np.sort(np.concatenate([self.ends_a, self.ends_b]), kind="stable")
        ends = ends[np.append(True, ends[1:] != ends[:-1])[: len(ends)]]
        one, other = np.searchsorted(self.ends_a, ends), np.searchsorted(self.ends_b, ends)
        return np.searchsorted(self.first_a, one, side="right") - 1, self.a[one] << 32 | self.b[other]


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """The groups of every document: doc_id, n_a, n_b and groups (array of `a1,a2|b1`, decimal ids in order).

    Side A is a byte-level tokenizer over a space and the text, side B a sentencepiece model over the
    text, before which it puts a space itself. Strings of special tokens are plain text. A group
    ends where tokens of both sides end.

    * A null or empty text, and one that the tokens of a side do not spell (it holds U+2581), has no tokens.
    * Repeated rows are repeated, a null doc_id stays null, extra columns are ignored, no rows give no rows.
    * A text is worked on whole, in a few numbers for each token; texts are cut into chunks at spaces, each
      distinct one is segmented once in a worker.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = _Aligned(part.column("text").to_pylist(), _both(byte_path, piece_path))
                groups = [g.decode().split(";") if g else [] for g in found.spelled()]
                columns = [part.column("doc_id"), pa.array(np.diff(found.first_a)), pa.array(np.diff(found.first_b)), pa.array(groups, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_a long, n_b long, groups array<string>")


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, slots binary, times binary"
_BLOCKS = f"block long, docs array<struct<{_DOC.replace(' ', ':').replace(',:', ',')}>>, slot int, pair long, held long"


def _blocks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row a block with its documents, and one for each distinct pair of it: slot, pair and how many of them hold it."""
    fields = [(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in _DOC.split(", "))]
    kinds = [pa.int64(), pa.list_(pa.struct(fields)), pa.int32(), pa.int64(), pa.int64()]
    names = ["block", "docs", "slot", "pair", "held"]

    def packed(rows, found, block):
        owner, flat = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((flat, owner))
        flat, owner = flat[order], owner[order]
        begin = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]))[: len(flat)])
        times = np.diff(np.append(begin, len(flat))).astype("<u4")
        pairs, slot, held = np.unique(flat[begin], return_inverse=True, return_counts=True)
        cuts, slot = np.searchsorted(owner[begin], np.arange(len(rows) + 1)).tolist(), slot.astype("<u4")
        each = [(*r, slot[p:q].tobytes(), times[p:q].tobytes()) for r, p, q in zip(rows, cuts[:-1], cuts[1:], strict=True)]
        yield record([[block], [[dict(zip((n for n, _ in fields), r, strict=True)) for r in each]], *[[None]] * 3])
        n = len(pairs)
        yield record([np.full(n, block), pa.nulls(n, kinds[1]), np.arange(n), pairs, held])

    def record(columns):
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches):
        task, n, rows, links, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                if rows and held + part.column("text").nbytes > BLOCK_BYTES:
                    yield from packed(rows, links, task << 32 | n)
                    n, rows, links, held = n + 1, [], [], 0
                held += part.column("text").nbytes
                found = _Aligned(part.column("text").to_pylist(), _both(byte_path, piece_path))
                owner, pairs = found.links()
                links.append((owner + len(rows), pairs))
                digests = (hashlib.sha256(g).hexdigest() if g else "" for g in found.spelled())
                counts = (np.diff(x).tolist() for x in (found.first_a, found.first_b, found.first_group))
                rows += zip(part.column("doc_id").to_pylist(), *counts, np.bincount(owner, minlength=part.num_rows).tolist(), digests, strict=True)
        if rows:
            yield from packed(rows, links, task << 32 | n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and whether no pair of its A id has a higher one.

    An A id meets at most every id of B, so that group is bounded by the vocabulary.
    """
    counts = blocks.where("pair is not null").groupBy("pair").agg(F.sum("held").alias("count"))
    top = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "count", (F.col("count") == top).alias("best"))


def link_statistics(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Alignment of every document, measured by the whole corpus. Rules for nulls and repeated rows are those of ``align``.

    Returns doc_id, n_a, n_b, n_groups, n_links (overlapping pairs of token occurrences), n_best (links
    whose pair is held by as many documents as any pair of its A id), count_sum (documents that hold
    the pair, over all links) and groups_sha256 (of the groups joined by `;`; '' without tokens).
    Each row of the table counts as a document.
    """
    blocks = as_table(_blocks(docs, byte_path, piece_path), "aligned")
    known = blocks.where("pair is not null").select("block", "slot", "pair").join(pair_counts(blocks), "pair")
    back = known.groupBy("block").agg(F.collect_list(F.struct("slot", "count", "best")).alias("known"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def measure(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, own = batch.column("docs")[k].values, batch.column("known")[k].values
                slot, count, best = (np.zeros(0, np.int64) if own is None else np.asarray(own.field(c)).astype(np.int64) for c in range(3))
                by_slot = np.zeros((2, len(slot)), np.int64)
                by_slot[:, slot] = count, best
                each = zip(rows.field("slots").to_pylist(), rows.field("times").to_pylist(), strict=True)
                sums = [(by_slot[:, np.frombuffer(s, "<u4")] * np.frombuffer(t, "<u4")).sum(axis=1) for s, t in each]
                columns = [*(rows.field(n) for n in names), *(pa.array([int(s[i]) for s in sums], pa.int64()) for i in (1, 0)), rows.field("groups_sha256")]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_best", "count_sum", "groups_sha256"])

    met = blocks.where("docs is not null").select("block", "docs").join(back, "block", "left").select("docs", "known")
    return met.mapInArrow(measure, ", ".join(f"{n} long" for n in [*names, "n_best", "count_sum"]) + ", groups_sha256 string")

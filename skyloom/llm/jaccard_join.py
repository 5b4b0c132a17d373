"""Exact Jaccard join of documents on five-word shingles, with vertical partitioning.

Shingles have one global order, rare ones first. Two sets that link must share a shingle
of their prefixes in that order; those pairs are the candidates. Pivots cut the order into fragments of about
equal weight, the sets with them. The fragments are counted one after the other, the rarest first: a pair's
partial overlaps are summed, and a pair that can no longer reach the similarity moves no further fragment.

* Equal sets are one set from the start.
* The order comes from counters of a fixed number, each shared by the shingles of one hash
  bucket. They cover all texts; which counter a shingle shares changes the order, not the result.
* A shingle in very many prefixes does not make all pairs of its sets. First each set meets
  only the leader of the shingle's sets of about its size (in a task the task's own leaders,
  and then those each other). Sets that are in one component by then need not meet: only sets of other components than a
  shingle's main one are compared further, first with one set of the main component for each
  shingle they share, at last with all that are left.
* Each set has a mark: for each of MARK_BITS buckets of shingles whether it holds an odd number of them. Two sets
  differ in at least as many shingles as their marks in bits, which bounds their overlap.
* That last step pairs two sets only where a shingle can be the first in the order that they share, since
  what follows it must then suffice; for a shingle of many sets the marks are compared inside the join, so that it
  makes rows only of pairs that link or nearly do. They are still compared, in time that
  grows with the square of the number of such sets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.components import components
from skyloom.llm.shared import arrow_map, lower_ascii, mix, slices, text_buffer, word_bounds, word_hashes
from skyloom.session import as_table, scratch_scope

WORDS = 5
#: Similarity, as a fraction.
PART, WHOLE = 75, 100
#: Counters of the global order. The more shingles share one, the less it tells rare ones from others; they are broadcast in 16 bits each.
ORDER_BITS = 22
#: Rows that a task's counters are packed in.
CHUNKS = 64
FRAGMENTS = 4
#: Prefix rows that a task puts together before it sends them.
HELD = 250_000
#: Rows of one Arrow batch of those.
PIECE = 1 << 16
#: Bits that tell which texts' sets are wanted; a false hit costs work, never a result.
FILTER_BITS = 24
#: Bits of a set's first name.
NAME_BITS = 64
#: Bits of a set's mark, in words of 64.
MARK_BITS = 512
MARK_WORDS = MARK_BITS // 64
#: Rows of a shingle from which marks are compared when its sets are paired. With fewer, a row makes no more pairs than this.
MANY = 128


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingles of each text: (text, hash) in order, and the number of texts. A text with fewer words is one shingle."""
    data, offsets = text_buffer(texts)
    n = len(offsets) - 1
    data = lower_ascii(data)
    starts, ends, first = word_bounds(data, offsets)
    words, size = word_hashes(data, starts, ends), np.diff(first)
    text_of = np.repeat(np.arange(n), size)
    found, owner = [], []
    for length in range(1, WORDS + 1):
        if length < WORDS:
            begin = first[:-1][size == length]
        else:
            begin = np.flatnonzero(text_of[WORDS - 1 :] == text_of[: len(text_of) - WORDS + 1]) if len(text_of) >= WORDS else first[:0]
        key = np.full(len(begin), length, np.uint64)
        for k in range(length):
            key = mix(key + words[begin + k])
        found.append(key)
        owner.append(text_of[begin])
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], found[new], n


class _Names:
    """A set is known by a 64-bit name; where different sets would share one, each of these goes by its second name instead.

    ``clashes`` are the names that different sets have: of N sets N * N / 2**65 are expected. Fewer ``bits`` are for tests.
    """

    def __init__(self, bits: int = NAME_BITS, clashes: list[int] = ()):
        self.mask = np.int64((1 << bits) - 1 if bits < 64 else -1)
        self.clashes = np.array(sorted(clashes), np.int64)

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        first = first & self.mask
        return np.where(np.isin(first, self.clashes), second, first) if len(self.clashes) else first


def _clashes(sets: DataFrame) -> list[int]:
    """The names that sets of different checks have, the empty set among them."""
    each = sets.groupBy("e").agg(F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    return [row.e for row in each.where("c0 <> c1 or n0 <> n1").select("e").toLocalIterator()]


def _sets(part: pa.RecordBatch, names: _Names) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of a piece of the table, its set sizes, and the name and 64-bit check of each set."""
    owner, found, n = shingles(part.column("text"))
    size = np.bincount(owner, minlength=n)
    cuts = np.concatenate([[0], np.cumsum(size)])
    made = []
    for salt in (0, 1):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found + np.uint64(salt)))])
        made.append(mix(total[cuts[1:]] - total[cuts[:-1]] + size.astype(np.uint64)).view(np.int64))
    return owner, found, size, names.of(*made), made[1]


def _profiles(docs: DataFrame, known: _Names) -> DataFrame:
    """One row a document: doc_id, text hash, set size, set and its check. And of each task its counters, packed in
    CHUNKS rows that have only chunk, part and counters."""
    names = ["doc_id", "t", "n", "e", "check", "chunk", "part", "counters"]

    def run(batches):
        counters = np.zeros(1 << ORDER_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                _, found, size, e, check = _sets(part, known)
                np.add.at(counters, (found & np.uint64(len(counters) - 1)).astype(np.int64), np.uint32(1))
                rows = [part.column("doc_id"), part.column("t"), *(pa.array(c, pa.int64()) for c in (size, e, check))]
                rows += [pa.nulls(len(size), kind) for kind in (pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names=names)
        chunks = [_squeezed(c) for c in np.split(counters, CHUNKS)]
        rows = [pa.nulls(CHUNKS, pa.int64()) for _ in names[:5]]
        rows += [pa.array(range(CHUNKS), pa.int64()), pa.array([TaskContext.get().partitionId()] * CHUNKS, pa.int64()), pa.array(chunks, pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, names=names)

    kinds = "doc_id long, t long, n long, e long, check long, chunk long, part long, counters binary"
    return arrow_map(docs.select("doc_id", "text", F.xxhash64("text").alias("t")), run, kinds)


def _squeezed(counters: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(counters, 2**32 - 1).astype("<u4").tobytes(), 1)


def _counters(profiles: DataFrame) -> np.ndarray:
    """Sum of the tasks' counters, in two steps so that no group grows with the tasks alone; 2**ORDER_BITS numbers at most."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64) for c in group["counters"])
        return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "counters": [_squeezed(total)]})

    packed = profiles.where("chunk is not null").select("chunk", "counters", (F.col("part") % CHUNKS).alias("salt"))
    some = packed.groupBy("chunk", "salt").applyInPandas(add, "chunk long, counters binary")
    rows = some.groupBy("chunk").applyInPandas(add, "chunk long, counters binary").collect()
    out = np.zeros((CHUNKS, (1 << ORDER_BITS) // CHUNKS), np.uint16)
    for row in rows:
        out[row.chunk] = np.minimum(np.frombuffer(zlib.decompress(row.counters), "<u4"), 2**16 - 1)
    return out.reshape(-1)


def pivots(counters: np.ndarray) -> np.ndarray:
    """Counts that cut the global order into FRAGMENTS fragments of about equal weight; equal counts stay together."""
    counts = np.sort(counters)
    weight = np.cumsum(counts, dtype=np.int64)
    return counts[np.searchsorted(weight, weight[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)]


def _prefix_size(n: np.ndarray) -> np.ndarray:
    return n + (PART * n) // -WHOLE + 1


def _needed(nx, ny):
    """Overlap that sets of these sizes need, as Spark columns."""
    return F.ceil(F.lit(PART) * (nx + ny) / F.lit(PART + WHOLE))


def _prefixes(owner, found, size, counters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle and place of the shingles in the prefixes, in the global order."""
    order = np.lexsort((found, counters[(found & np.uint64(len(counters) - 1)).astype(np.int64)], owner))
    owner, found = owner[order], found[order]
    cuts = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(len(owner)) - cuts[owner]
    inside = place < _prefix_size(size)[owner]
    return owner[inside], found[inside], place[inside]


#: Shingle, set, and in one number the set's size, its group's largest size and the shingle's place; DIRECT there: a pair of sets.
_ROW = "t long, e long, p long"
_DIRECT = -1
_STEPS = 3 << 12


def _packed(n: np.ndarray, high: np.ndarray, i: np.ndarray) -> np.ndarray:
    """26 bits of size, 13 of (largest / size - 1) rounded up (0: no other member), 24 of place. Order is that of the size."""
    more = np.minimum(np.ceil((high / np.maximum(n, 1) - 1) * _STEPS), 2**13 - 1).astype(np.int64)
    return n << 37 | more << 24 | np.minimum(i, 2**24 - 1)


def _unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, more, i = p >> 37, p >> 24 & (2**13 - 1), p & (2**24 - 1)
    return n, np.ceil(n * (1 + more / _STEPS)).astype(np.int64), i


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


class _Groups:
    """Sets of each shingle, met in the order of their sizes.

    A group has a leader, and takes in what is not too large to link with it. Its members meet
    the leader only. Every set that could link with some member without having met it is named
    (a pair with itself), so that it is compared later; a set whose possible partners were all
    met is not. A group that came as one row may hold larger sets than the leaders after it, so
    ``reach``, the largest size of any group of the shingle by now, decides who could link.

    Rows come in pieces, ordered by shingle and size. Groups of all shingles of a piece are cut side by side, one of
    each shingle in a round; the last group stays open for the next piece.
    """

    def __init__(self):
        self._open, self._reach, self._closed, self._pairs = None, 0, [], []

    def meet(self, t, e, n, high, i):
        rows = np.array([t, e, n, high, i], np.int64).reshape(5, -1)
        if not rows.shape[1]:
            return
        reach = 0
        if self._open is not None and self._open[0] == rows[0, 0]:
            rows, reach = np.concatenate([self._open[:, None], rows], axis=1), self._reach
        elif self._open is not None:
            self._closed.append(self._open[:, None])
        t, e, n, high, i = rows
        new = np.append(True, t[1:] != t[:-1])
        shingle, first = np.cumsum(new) - 1, np.flatnonzero(new)
        stop = np.append(first[1:], len(t))
        order, at, starts = shingle << 26 | n, first, []
        while len(at):  # what is too large for the leader opens the next group
            starts.append(at)
            most = np.minimum(WHOLE * n[at] // PART, 2**26 - 1)
            after = np.searchsorted(order, shingle[at] << 26 | most, side="right")
            at = after[after < stop[shingle[at]]]
        starts = np.sort(np.concatenate(starts))
        size, of = np.diff(np.append(starts, len(t))), shingle[starts]
        top = np.maximum.reduceat(high, starts)
        top = np.where(size > 1, np.maximum(top, n[starts] + 1), top)
        largest = np.maximum.accumulate(of << 38 | top) & (2**38 - 1)
        largest[of == 0] = np.maximum(largest[of == 0], reach)

        later = np.flatnonzero(of[1:] == of[:-1]) + 1
        named = e[starts[later[PART * n[starts[later]] <= WHOLE * largest[later - 1]]]]
        lead = np.repeat(starts, size)
        met = np.flatnonzero(e != e[lead])
        lead = lead[met]
        needed = -(-PART * (n[lead] + n[met]) // (PART + WHOLE))
        can = np.minimum(i[lead], i[met]) + np.minimum(n[lead] - i[lead], n[met] - i[met]) >= needed
        named = np.concatenate([named, e[lead[~can]], e[met[~can]]])
        self._pairs.append((np.concatenate([e[lead[can]], named]), np.concatenate([e[met[can]], named])))
        groups = np.stack([t[starts], e[starts], n[starts], top, i[starts]])
        self._closed.append(groups[:, :-1])
        self._open, self._reach = groups[:, -1], largest[-1]

    def take_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs since the last call. Closed groups are forgotten."""
        pairs = _distinct(*(np.concatenate([p[k] for p in self._pairs] or [np.zeros(0, np.int64)]) for k in (0, 1)))
        self._pairs, self._closed = [], []
        return pairs

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return [pair for a, b in self._pairs for pair in zip(a.tolist(), b.tolist(), strict=True)]

    @property
    def leaders(self) -> np.ndarray:
        """Of each group its leader's row, with the largest size of the group."""
        return np.concatenate([*self._closed, self._open[:, None]], axis=1).T


def _star_rows(docs: DataFrame, counters, known: _Names) -> DataFrame:
    """For each shingle of a prefix and part of a task the leaders of its groups, and the pairs that the part's sets make."""

    def run(batches):
        seen, held = set(), []
        for batch in batches:
            for part in slices(batch, "text"):
                owner, found, size, e, _ = _sets(part, known)
                new = np.array([not (x in seen or seen.add(x)) for x in e.tolist()], bool)
                owner, found, place = _prefixes(owner, found, size, counters.value)
                ok = new[owner]
                owner = owner[ok]
                held.append((found[ok].view(np.int64), e[owner], size[owner].astype(np.int32), place[ok].astype(np.int32)))
                if sum(len(h[0]) for h in held) > HELD:  # what one part of a task holds
                    yield from combine(held)
                    held = []
        yield from combine(held)

    def combine(held):
        if not held:
            return
        t, e, n, i = (np.concatenate(c).astype(np.int64) for c in zip(*held, strict=True))
        if not len(t):
            return
        order = np.lexsort((e, n, t))
        groups = _Groups()
        groups.meet(t[order], e[order], n[order], n[order], i[order])
        t, e, n, high, i = groups.leaders.T
        yield from pieces(t, e, _packed(n, high, i))
        a, b = groups.take_pairs()
        yield from pieces(a, b, np.full(len(a), _DIRECT))

    def pieces(*columns):
        for k in range(0, len(columns[0]), PIECE):
            yield batch_of(*(c[k : k + PIECE] for c in columns))

    def batch_of(t, e, p):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (t, e, p)], names=["t", "e", "p"])

    return arrow_map(docs.select("text"), run, _ROW)


def _star_pairs(rows: DataFrame) -> DataFrame:
    """Candidate pairs, and pairs of a set with itself for what is to be compared later. One shuffle; a part of a task
    sends one row for each shingle and group."""
    ordered = rows.repartition("t").sortWithinPartitions("t", "p", "e")

    def meet(batches):
        groups = _Groups()
        for batch in batches:
            t, e, p = (np.asarray(batch.column(c)).astype(np.int64) for c in ("t", "e", "p"))
            direct = p == _DIRECT
            yield pa.RecordBatch.from_arrays([pa.array(t[direct]), pa.array(e[direct])], names=["a", "b"])
            t, e, p = t[~direct], e[~direct], p[~direct]
            groups.meet(t, e, *_unpacked(p))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in groups.take_pairs()], names=["a", "b"])

    return arrow_map(ordered, meet, "a long, b long").distinct()


def _marks(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each set, whose shingles begin at ``starts``, the parities of its buckets in MARK_WORDS numbers. No set is empty."""
    bucket = found >> np.uint64(65 - MARK_BITS.bit_length())
    word, bit = bucket >> np.uint64(6), np.uint64(1) << (bucket & np.uint64(63))
    return np.stack([np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), starts) for w in range(MARK_WORDS)], axis=1).view(np.int64)


def _can_link(nx, ny, mx, my):
    """Whether sets of these sizes and marks can link, as Spark columns: they differ in as many shingles as their marks in bits, or more."""
    differ = sum((F.bit_count(mx[w].bitwiseXOR(my[w])) for w in range(MARK_WORDS)), F.lit(0))
    return nx + ny - differ >= 2 * _needed(nx, ny)


def _wanted_sets(docs: DataFrame, wanted, counters, known: _Names) -> DataFrame:
    """Sets of the texts that the filter's bits name, by fragment (the first one even if it is empty): shingles in the global
    order, and how many come before them. The first fragment has the set's mark. Only these texts are cut into shingles."""
    cuts = pivots(counters.value)
    names = ["e", "n", "fragment", "before", "tokens", "mark"]

    def run(batches):
        seen = set()
        for batch in batches:
            ids, t = (np.asarray(batch.column(c).fill_null(0)).astype(np.int64) for c in ("doc_id", "t"))
            for part in slices(batch.filter(pa.array(wanted.value[_bit(t, ids)])), "text"):
                owner, found, size, e, _ = _sets(part, known)
                one = (size > 0) & np.array([not (x in seen or seen.add(x)) for x in e.tolist()], bool)
                rows = np.flatnonzero(one)
                if not len(rows):
                    continue
                owner, found = owner[one[owner]], found[one[owner]]
                marks = _marks(found, np.searchsorted(owner, rows))
                count = counters.value[(found & np.uint64(len(counters.value) - 1)).astype(np.int64)].astype(np.int64)
                order = np.lexsort((found, count, owner))
                tokens = found[order].view(np.int64)
                group = owner[order] * FRAGMENTS + np.searchsorted(cuts, count[order], side="right")
                parts = (rows[:, None] * FRAGMENTS + np.arange(FRAGMENTS)).ravel()
                begin, end = np.searchsorted(group, parts), np.searchsorted(group, parts, side="right")
                before = begin - np.repeat(begin[::FRAGMENTS], FRAGMENTS)
                there = (begin < end) | (parts % FRAGMENTS == 0)
                of = parts[there] // FRAGMENTS
                columns = [pa.array(c, pa.int64()) for c in (e[of], size[of], parts[there] % FRAGMENTS, before[there])]
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin[there], len(tokens)), pa.int32()), pa.array(tokens, pa.int64()))
                marked = np.cumsum(np.append(0, np.where(parts[there] % FRAGMENTS == 0, MARK_WORDS, 0)))
                marks = pa.ListArray.from_arrays(pa.array(marked, pa.int32()), pa.array(marks.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, lists, marks], names=names)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    return arrow_map(rows, run, "e long, n long, fragment long, before long, tokens array<long>, mark array<long>")


def _prefix_rows(sets: DataFrame) -> DataFrame:
    """Prefix rows of whole sets."""
    inside = F.expr(f"n - (n * {PART} + {WHOLE - 1}) div {WHOLE} + 1 - before")
    cut = sets.select("e", "n", "before", "tokens", inside.cast("int").alias("inside")).where("inside > 0")
    rows = cut.select("e", "n", "before", F.posexplode(F.slice("tokens", F.lit(1), F.col("inside"))).alias("at", "t"))
    place = F.least(F.col("before") + F.col("at"), F.lit(2**24 - 1))
    return rows.select("t", "e", F.shiftleft("n", 37).bitwiseOR(place).alias("p"))


def _once(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row a key. Only rows that equal input rows have given twice are moved for it."""
    twice = as_table(rows.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").select(*key), "twice")
    if twice.isEmpty():
        return rows
    return rows.join(twice, key, "left_anti").unionByName(rows.join(twice, key, "left_semi").dropDuplicates(key))


def _shared_prefixes(rows: DataFrame) -> DataFrame:
    """Prefix rows (t, e, n, i) of shingles in the prefixes of two sets at least; equal rows once."""

    def several(batches):
        last, told = None, False  # the last row waits until it is known whether its shingle goes on
        for batch in batches:
            t, e, p = (np.asarray(batch.column(c)).astype(np.int64) for c in ("t", "e", "p"))
            if last is not None:
                t, e, p = (np.concatenate([[x], c]) for x, c in zip(last, (t, e, p), strict=True))
            if not len(t):
                continue
            new = np.append(True, (t[1:] != t[:-1]) | (e[1:] != e[:-1]))
            t, e, p = t[new], e[new], p[new]
            same = t[1:] == t[:-1]
            shared = np.append(same, False) | np.append(told, same)
            last, told = (int(t[-1]), int(e[-1]), int(p[-1])), bool(shared[-1])
            ready = np.append(shared[:-1], False)
            yield record(t[ready], e[ready], p[ready])
        if told:
            yield record(*(np.array([x]) for x in last))

    def record(t, e, p):
        n, _, i = _unpacked(p)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (t, e, n, i)], names=["t", "e", "n", "i"])

    ordered = rows.repartition("t").sortWithinPartitions("t", "e")
    return arrow_map(ordered, several, "t long, e long, n long, i long")


def _bit(t: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (mix(mix(t.view(np.uint64)) + ids.view(np.uint64)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _bits(rows: DataFrame) -> np.ndarray:
    """Filter of (text hash, id) rows: distinct bit numbers, 2**FILTER_BITS at most whatever the rows."""

    def number(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bit": np.unique(_bit(*(np.asarray(batch.column(c)).astype(np.int64) for c in (0, 1))))})

    found = arrow_map(rows, number, "bit long").distinct().toArrow().column(0).to_numpy()
    out = np.zeros(1 << FILTER_BITS, bool)
    out[found] = True
    return out


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that link. Fragments are counted one after the other, the rarest first: of each only the
    sets of pairs that can still reach the similarity move."""
    counted = {c: F.lit(0).cast("long") for c in ("shared", "done_a", "done_b")}
    alive = pairs.select("a", "b").withColumns(counted)
    left = F.least(F.col("na") - F.col("done_a"), F.col("nb") - F.col("done_b"))
    for fragment in range(FRAGMENTS):
        # Written first, so that the overlap is not counted again by the filter.
        alive = as_table(_counted(alive, sets.where(F.col("fragment") == fragment), fragment), "alive")
        alive = alive.where(F.col("shared") + left >= _needed(F.col("na"), F.col("nb")))
    return alive.select("a", "b")


def _counted(alive: DataFrame, sets: DataFrame, fragment: int) -> DataFrame:
    """Pairs with one more fragment counted. The first one tells the sizes."""
    ids = alive.select(F.col("a").alias("e")).union(alive.select(F.col("b").alias("e"))).distinct()
    own = sets.join(ids, "e", "left_semi").select("e", "tokens", *(["n"] if not fragment else []))
    for side in "ab":
        renamed = own.toDF(side, f"t{side}", *([f"n{side}"] if not fragment else []))
        alive = alive.join(renamed, side, "left")
    none = F.array().cast("array<long>")
    ta, tb = F.coalesce("ta", none), F.coalesce("tb", none)
    more = {"shared": F.size(F.array_intersect(ta, tb)), "done_a": F.size(ta), "done_b": F.size(tb)}
    return alive.select("a", "b", "na", "nb", *((F.col(c) + k).alias(c) for c, k in more.items()))


def _open_rows(prefixes: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefix rows of shingles that sets of several components share, with the component c and the shingle's main one;
    (and whether it has MANY rows); and for each such shingle one set of the main component. Rows move once, by shingle."""
    labelled = prefixes.join(roots, prefixes["e"] == roots["u"], "left").select("t", "e", "n", "i", F.coalesce("root", "e").alias("c")).repartition("t")
    groups = labelled.groupBy("t", "c").agg(F.count("*").alias("k"), F.min_by(F.struct("e", "n", "i"), F.xxhash64("e", "t")).alias("some"))
    shared = groups.groupBy("t").agg(F.max(F.struct("k", "c", "some")).alias("m"), F.count("*").alias("groups"), F.sum("k").alias("rows")).where("groups > 1")
    shared = as_table(shared.select("t", F.col("m.c").alias("main"), F.col("m.some").alias("some"), (F.col("rows") > MANY).alias("many")), "open-shingles")
    return as_table(labelled.join(shared.select("t", "main", "many"), "t"), "open-rows"), shared


def link_sets(docs: DataFrame, name_bits: int = NAME_BITS) -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows (doc_id, t, n, e) and the roots of linked sets (u, root). What was written for it is deleted."""
    with scratch_scope(docs.sparkSession):
        sets, roots = _linked(docs, name_bits)
        return sets, as_table(roots, "roots", keep=True)


def _linked(docs: DataFrame, name_bits: int) -> tuple[DataFrame, DataFrame]:
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = as_table(_profiles(rows, _Names(name_bits)), "profiles", keep=True)
    counters = sc.broadcast(_counters(profiles))
    sets = profiles.where("chunk is null").select("doc_id", "t", "n", "e", "check")
    clashes = _clashes(sets)
    known = _Names(name_bits, clashes)
    if clashes:
        sets = sets.withColumn("e", F.when(F.col("e").isin(clashes), F.col("check")).otherwise(F.col("e")))
    pairs = as_table(_star_pairs(_star_rows(rows, counters, known)), "pairs")

    named = pairs.select(F.col("a").alias("e")).union(pairs.select(F.col("b").alias("e"))).distinct()
    firsts = sets.where("n > 0").groupBy("e").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "t")).alias("m"))
    wanted = sc.broadcast(_bits(firsts.join(named, "e", "left_semi").select("m.t", "m.id")))
    whole = _once(as_table(_wanted_sets(rows, wanted, counters, known), "sets"), ["e", "fragment"])
    pairs = pairs.where("a <> b")
    roots = components(_links(pairs, whole))
    prefixes = as_table(_shared_prefixes(_prefix_rows(whole)), "prefixes")

    tested = pairs
    for last in (False, True):
        rows_open, mains = _open_rows(prefixes, roots)
        if last:
            again = _first_met(rows_open, whole.where("fragment = 0").select("e", "mark"))
        else:
            again = _main_met(rows_open.where("c <> main"), mains)
        again = as_table(again.join(tested, ["a", "b"], "left_anti"), "more-pairs")
        if again.isEmpty():
            continue
        more = _links(again, whole)
        tested = tested.union(again)
        if more.take(1):
            roots = components(roots.select("u", "root").union(more))  # the components by now are what their links say
    return sets, roots


def _main_met(outside: DataFrame, mains: DataFrame) -> DataFrame:
    """Pairs of an outside set with the shingle's set of the main component, where sizes and places let them link."""
    met = outside.join(mains.select("t", F.col("some.e").alias("f"), F.col("some.n").alias("m"), F.col("some.i").alias("j")), "t")
    before, after = F.least("i", "j"), F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    met = met.where(before + after >= _needed(F.col("n"), F.col("m")))
    return met.select(F.least("e", "f").alias("a"), F.greatest("e", "f").alias("b")).distinct()


def _first_met(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs of sets of different components that can link if a shingle is the first in the order that they share:
    nothing before it counts, so what follows it in both must be enough. Every link has such a shingle.
    Where a shingle has many sets, their marks must let them link, too."""
    few = _met(rows.where("not many"))
    many = _met(rows.where("many").join(marks, "e"), marked=True)
    return few.union(many).distinct()


def _met(rows: DataFrame, marked: bool = False) -> DataFrame:
    x, y = rows.where("c <> main").alias("x"), rows.alias("y")
    nx, ny, ix, iy = F.col("x.n"), F.col("y.n"), F.col("x.i"), F.col("y.i")
    enough = F.least(nx - ix, ny - iy) >= _needed(nx, ny)
    once = (F.col("y.c") == F.col("y.main")) | (F.col("x.e") < F.col("y.e"))
    meet = (F.col("x.t") == F.col("y.t")) & (F.col("x.c") != F.col("y.c")) & once & enough
    if marked:
        meet &= _can_link(nx, ny, F.col("x.mark"), F.col("y.mark"))
    return x.join(y, meet).select(F.least("x.e", "y.e").alias("a"), F.greatest("x.e", "y.e").alias("b"))


def join(docs: DataFrame, name_bits: int = NAME_BITS) -> DataFrame:
    """One row for each document: doc_id, n_shingles and component_id, with _text_hash to tell rows of one id apart
    and _kept for the one doc_id (nulls last) and text hash that come first in each component.

    A-Z are lower-cased; words are runs of characters other than space and \\x09-\\x0D;
    the set of a document is its distinct five-word shingles, or all its words as one if
    it has fewer. Documents link when the Jaccard similarity of their sets is at least
    PART / WHOLE. component_id is the least doc_id that links lead to.

    * A null text or one without words has an empty set and links with nothing.
    * A null doc_id links others but is nobody's least id; its own component_id is that of
      its component, null if no member has an id.
    * Repeated rows are repeated. Extra columns are ignored. No rows give no rows.
    * Shingles are known by 64-bit hashes, sets by names of 64 bits; sets that would share a name go by a second one, so two
      sets are taken for one only if both names agree. A second name that is also some other set's name is noticed and is an error.
    """
    sets, roots = link_sets(docs, name_bits)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    classes = sets.where("n > 0").groupBy("e").agg(F.min("doc_id").alias("rep"), F.min(rank).alias("first"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("check").alias("c0"), F.max("check").alias("c1"))
    sound = F.when((F.col("n0") == F.col("n1")) & (F.col("c0") == F.col("c1")), F.col("e")).otherwise(F.raise_error(F.lit("Two shingle sets have one hash.")).cast("long"))
    rooted = classes.select(sound.alias("e"), "rep", "first").join(roots, F.col("e") == F.col("u"), "left").select("e", "rep", "first", F.coalesce("root", "e").alias("root"))
    rooted = as_table(rooted, "classes")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"), F.min("first").alias("kept"))
    named = rooted.join(least, "root").select("e", "component", "kept")
    out = sets.join(named, "e", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    kept = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & F.col("t").eqNullSafe(F.col("kept.t")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("t").alias("_text_hash"), kept.alias("_kept"))

import bisect
import math
import random
import zlib

import numpy as np

from skyloom.llm import packing, topk
from skyloom.llm.queries import tokenizer


def by_hand(vectors, queries, k):
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in usable:
        if q in queries:
            scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in usable if i != q and len(v) == len(qv))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def frame(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<float>")


def test_topk_equals_all_scores(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(150)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(40)]  # ties, over the tenth place too
    vectors += [(5000, None), (5001, []), (5002, [1.0, None] * 3), (5003, [float("nan")] * 6), (5004, [float("inf")] * 6), (5005, [1.0, 2.0]), (None, [1.0] * 6)]
    df = frame(spark, vectors).repartition(7)
    for block in (1024, 2):
        got = topk.exact_topk(df, df.where("vec_id in (0, 3, 100, 5002, 5005)"), k=10, block=block)
        assert sorted(map(tuple, got.collect())) == by_hand(vectors, {0, 3, 100, 5002, 5005}, 10)


def test_topk_of_large_components_and_few_rows(spark):
    vectors = [(0, [3.0e12, -1.0e12]), (1, [2.0e12, 5.0e11]), (2, [1.0, 1.0])]
    df = frame(spark, vectors)
    got = topk.exact_topk(df, df, k=10)
    limit = 2**63 - 1
    want = [(q, r, i, max(-limit, min(limit, s))) for q, r, i, s in by_hand(vectors, {0, 1, 2}, 10)]
    assert {(q, i, s) for q, _, i, s in map(tuple, got.collect())} == {(q, i, s) for q, _, i, s in want}
    assert topk.exact_topk(frame(spark, []), frame(spark, [])).count() == 0


def test_topk_of_crowded_bins_in_several_passes(spark):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = unit(np.repeat(unit(rng.normal(size=(150, 32))), 20, axis=0) + rng.normal(scale=0.01, size=(3000, 32))).astype(np.float32)
    df = frame(spark, list(enumerate(rows.tolist()))).repartition(4)
    whole = np.floor(1024 * rows.astype(float)).astype(int)
    want = []
    for q in range(0, 3000, 15):
        scores = whole @ whole[q]
        scores[q] = -(2**62)
        want += [(q, r + 1, i, int(scores[i])) for r, i in enumerate(np.lexsort((np.arange(3000), -scores))[:10].tolist())]
    got = topk.exact_topk(df, df.where("vec_id % 15 = 0"), k=10)
    assert sorted(map(tuple, got.collect())) == want


def plain_best_fit(lengths, capacity):
    free, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, length)
        if at < len(free):
            left = free.pop(at) - length
        else:
            left, n = capacity - length, n + 1
        bisect.insort(free, left)
    return n


def check_places(rows, capacity):
    taken = {}
    for r in rows:
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in taken.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(taken)


def test_plan_is_best_fit_over_counts(spark):
    rng = random.Random(2)
    for _ in range(30):
        capacity = rng.choice([5, 17, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))] + [rng.randint(1, capacity)] * rng.randint(0, 50)
        counts = {n: lengths.count(n) for n in set(lengths)}
        slots = packing.plan_slots(counts, capacity)
        assert sum(s[2] for s in slots) == len(lengths)
        used = {s[4] + k // s[3] for s in slots for k in range(s[2])}
        assert len(used) == plain_best_fit(lengths, capacity)
    many = packing.plan_slots({2048: 10**12, 700: 10**11 + 1, 300: 7 * 10**10, 1: 5})
    assert len(many) < 50


def test_pack_gives_every_piece_a_place(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 50), k % 3, rng.choice([1, 9, 9, 9, 30, 64]), "x", 5) for k in range(900)] + [(None, 0, 9, None, None), (1, 0, 9, "same", 1), (1, 0, 9, "same", 1)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, _part string, sequence_id int")
    got = packing.pack(df, 64).collect()
    assert sorted(((r.doc_id, r.piece, r.length, r._part) for r in got), key=str) == sorted((r[:4] for r in rows), key=str)
    assert check_places(got, 64) == plain_best_fit([r[2] for r in rows], 64)
    assert packing.pack(df.limit(0), 64).count() == 0


def test_pieces_are_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    from tests.llm.helpers import documents

    path = tokenizer("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = [None, "", " \n", "Hello, World. don't stop", "<|endoftext|> a<|startoftext|>b", "it's we're\x1cfoo\x85bar 12a3", "é ́x 漢字 😀", "x" * 9000, "a. b, c" * 900, "hello, world. " * 700]
    rows = packing.token_pieces(documents(spark, texts), path).collect()
    for i, text in enumerate(texts):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        assert b"".join(bytes(r.ids) for r in mine) == np.array(ids, "<u4").tobytes()
        assert [(r.piece, r.start, r.length) for r in mine] == [(k, 2048 * k, min(2048, len(ids) - 2048 * k)) for k in range(len(mine))]
    assert zlib.crc32(np.array([0], "<u4").tobytes()) == zlib.crc32(bytes(next(r for r in rows if r.doc_id == 0).ids))


def test_words_that_differ_in_marks_or_case_share_their_pieces():
    from tokenizers import Tokenizer

    from skyloom.llm.word_bpe import encoder

    path = tokenizer("word_bpe_49k.json")
    own, (table, words) = Tokenizer.from_file(path), encoder(path)
    texts = ["Hello, hello. HELLO### über,%% Über. hello", "n\u0303o ÑO. J\u030cx jx", "don't DON'T a12b <|endoftext|>x", "a\x1cb\u00a0c µ÷×"]
    ids, first = table.ids([words.pieces(t) for t in texts])
    for k, text in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == own.encode(text, add_special_tokens=False).ids
    assert set(words.pieces(texts[0])) == {"hello", "über", ",", ".", "###", ",%%"}


def test_workers_get_small_batches(spark):
    import pyarrow as pa

    from skyloom.llm import shared

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 5000) AS text")
    seen = [r.n for r in shared.arrow_map(rows, sizes, "n long").collect()]
    assert len(seen) > 1 and max(seen) < 1.1 * shared.BATCH_BYTES

import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from skyloom.llm import alignment
from skyloom.llm.queries import tokenizer

from .helpers import DATA, documents, needs_data

BYTES, PIECES = (tokenizer(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain_tokens(text):
    """Ids and bytes of both sides by the libraries on whole texts; None if they do not spell space + text."""
    import sentencepiece
    from tokenizers import Tokenizer

    global _loaded
    if "_loaded" not in globals():
        side = Tokenizer.from_file(BYTES)
        side.encode_special_tokens = True
        vocabulary = {i: t for t, i in side.get_vocab().items()}
        _loaded = side, vocabulary, sentencepiece.SentencePieceProcessor(model_file=PIECES)
    side, vocabulary, model = _loaded
    if not text:
        return None
    alphabet = alignment.byte_alphabet()
    a = side.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    a_bytes = [bytes(alphabet[c] for c in vocabulary[i]) for i in a]
    b_bytes = []
    for i in b:
        piece = model.id_to_piece(i)
        byte = re.fullmatch(r"<0x(..)>", piece)
        b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return None
    spans = []
    for ids, pieces in ((a, a_bytes), (b, b_bytes)):
        at, own = 0, []
        for i, piece in zip(ids, pieces, strict=True):
            own.append((at, at + len(piece), i))
            at += len(piece)
        spans.append(own)
    return spans


def by_hand(rows):
    found, held = [], defaultdict(int)
    for doc, text in rows:
        spans = plain_tokens(text)
        if spans is None:
            found.append((doc, [], [], [], ""))
            continue
        a, b = spans
        links, j = [], 0
        for x in a:
            while b[j][1] <= x[0]:
                j += 1
            k = j
            while k < len(b) and b[k][0] < x[1]:
                links.append((x[2], b[k][2]))
                k += 1
        ends = {e for _, e, _ in a} & {e for _, e, _ in b}
        parts = []
        for side in spans:
            parts.append([[]])
            for _, end, i in side:
                parts[-1][-1].append(str(i))
                if end in ends:
                    parts[-1].append([])
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*parts, strict=True)][:-1]
        for pair in set(links):
            held[pair] += 1
        found.append((doc, a, b, links, groups))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for doc, a, b, links, groups in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), digest))
    return sorted(out, key=str)


TEXTS = [
    None, "", " ", "a", "Hello world", "Hello  world", " two  spaces \n and\nlines\t\ttabs ", "<|endoftext|> <s> </s> <unk> <0x0A> plain", "▁marker inside", "naïve café — 漢字かな交じり文 🙂🙂👩‍👩‍👧",
    "nbsp here   wide space \x1c\x1d x\x85y", "don't we'll I'm 12345 3.14159", "supercalifragilisticexpialidocious" * 5, "\n\n\n", "a\r\nb\r\n  c", "\x00\x01\x02", "Hello world", "é ​ zero",
]


def test_statistics_equal_libraries_on_whole_texts(spark, monkeypatch):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["the ", "of", " in", "gen", "\n", " ", "é", "ß", "。", "ing ", "12", "!", "▁" if rng.random() < 0.02 else "x"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = list(enumerate(texts))
    rows += [(None, "Hello world"), (3, "a"), (3, "a")]
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)
    want = by_hand(rows)
    for size in (alignment.BLOCK_BYTES, 300):  # one block a task, and many
        monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
        got = alignment.link_statistics(df, BYTES, PIECES)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    aligned = {r.doc_id: r for r in alignment.align(df.where("doc_id = 4"), BYTES, PIECES).collect()}
    assert aligned[4].groups and aligned[4].n_a >= len(aligned[4].groups)


def test_groups_end_at_the_common_ends():
    rng = random.Random(4)
    for _ in range(500):
        size = rng.randrange(1, 80)
        a, b = (sorted({*rng.sample(range(1, size + 1), rng.randrange(0, size + 1)), size}) for _ in range(2))
        if rng.random() < 0.3:
            b = list(a)
        n, m = alignment.group_sizes(np.array(a), np.array(b))
        common = sorted(set(a) & set(b))
        assert [a[k - 1] for k in np.cumsum(n)] == common == [b[k - 1] for k in np.cumsum(m)]
    assert [len(x) for x in alignment.group_sizes(np.zeros(0, int), np.zeros(0, int))] == [0, 0]


def test_statistics_of_no_rows_extra_columns_and_long_texts(spark):
    df = spark.createDataFrame([(1, "one two " * 60_000, 5, "x"), (2, "x" * 20_000, 6, "y")], "doc_id long, text string, n_a long, groups string")
    assert alignment.link_statistics(df.limit(0), BYTES, PIECES).count() == 0
    got = {r.doc_id: r for r in alignment.link_statistics(df, BYTES, PIECES).collect()}
    a, b = plain_tokens("one two " * 60_000)
    assert (got[1].n_a, got[1].n_b) == (len(a), len(b)) and got[2].n_a == len(plain_tokens("x" * 20_000)[0])


@needs_data
def test_statistics_of_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("length(text) < 6000")
    got = sorted((tuple(r) for r in alignment.link_statistics(docs, BYTES, PIECES).collect()), key=str)
    assert got == by_hand([tuple(r) for r in docs.collect()])

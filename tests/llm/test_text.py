import random

import numpy as np
import pytest

from skyloom.llm import forest, langid, quality, sentencepieces, toxicity
from skyloom.llm.queries import CATEGORIES, tokenizer
from tests.llm.helpers import documents, word_counts


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  b   c", "a\nb\t c\n", "▁x ▁ y▁▁z", "<s> </s> <unk> <0x0A>", "漢字 😀 é ́", "\ufeffhey\u200b \xa0x", "a\x00b", "word " * 5000, "y" * 50_000]
    rng = random.Random(4)
    texts += ["".join(rng.choice(" \nab▁.é") for _ in range(30)) for _ in range(200)]
    got = {r.doc_id: r for r in sentencepieces.encode_decode(documents(spark, texts), path).collect()}
    for i, text in enumerate(texts):
        ids = [own.bos_id(), *own.encode(text or ""), own.eos_id()]
        assert bytes(got[i].ids) == np.array(ids, "<u4").tobytes() and got[i].n_tokens == len(ids), text
        assert got[i].decoded == own.decode(ids)
    assert sentencepieces.encode_decode(documents(spark, []), path).count() == 0


def test_counts_equal_plain_python(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "\n", "a\n\na\n", "a b c a b c", "x\ny\nx", "a a a a", "é\xa0è\x1cz b", "a\r\na\r\nb", " \n a\n a", "end\n", "# * $%&|<>"]
    texts += ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = documents(spark, texts).repartition(3)
    labels = spark.createDataFrame([(0, None), (1, 1)], "doc_id long, quality int")
    for r in quality.judge(docs, labels).collect():
        counts = word_counts(texts[r.doc_id])
        assert tuple(r[c] for c in quality.COUNTS) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.kept and r.base_failed)
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_repeated_labelled_rows_lose_no_class(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["good", "plain", "words", "here."]) for _ in range(80)) if i % 2 else " ".join(rng.choice("# $ x 9") for _ in range(80)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = documents(spark, texts)
    many = once
    for _ in range(9):
        many = many.union(once)
    one, other = (quality.train(d, labels, rows=40) for d in (once, many))
    features = quality.statistics(once.toArrow().column("text").combine_chunks())[1]
    assert np.array_equal(one.probability(features), other.probability(features))
    assert np.ptp(one.probability(features)) > 0.5


def test_forest_learns_and_stays_monotonic():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] - 2 * (x[:, 1] > 0) + rng.normal(size=3000) * 0.3 > 0).astype(float)
    model = forest.train(x[:2000], y[:2000], [1, -1, 0])
    assert ((model.probability(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    row = np.zeros((50, 3))
    row[:, 0] = np.linspace(-3, 3, 50)
    assert (np.diff(model.margin(row)) >= -1e-12).all()
    row = np.zeros((50, 3))
    row[:, 1] = np.linspace(-3, 3, 50)
    assert (np.diff(model.margin(row)) <= 1e-12).all()
    assert forest.train(np.zeros((0, 3)), np.zeros(0), [0, 0, 0]).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_quality_on_held_out_labels(spark):
    rng = random.Random(7)
    good = [" ".join(rng.choice(["plain", "words", "of", "some", "text", "here"]) + str(rng.randrange(99)) for _ in range(80)) for _ in range(150)]
    bad = [" ".join(w + "***" for w in t.split()) for t in good[:80]]
    texts = good + bad
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(len(texts)) if i % 2], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert all(got[i] == (i < 150) for i in range(len(texts)))


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(8)
    texts, toxic = [], []
    for i in range(600):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(30)}" for _ in range(rng.randint(5, 60))]
        toxic.append(int(i % 6 == 0))
        if toxic[-1]:
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "Nastyone", "nastytwo,"]))
        texts.append(" ".join(words))
    return texts, toxic


def test_toxicity_on_held_out_labels(spark, mixed):
    texts, toxic = mixed
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, toxic[i]) for i in range(400)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.p_toxic >= 0.5 for r in toxicity.score(docs, labels, CATEGORIES).collect()}
    assert sum(got[i] == bool(toxic[i]) for i in range(400, 600)) >= 197


def test_chain_feeds_earlier_categories(mixed):
    texts, toxic = mixed
    import pyarrow as pa

    row, feature, n = toxicity._features(pa.array(texts))
    y = np.array(toxic, float)
    chain = toxicity.train(np.arange(n), row, feature, np.stack([y, y], axis=1))
    assert chain[0].earlier.shape == (0,) and chain[1].earlier.shape == (1,) and chain[1].earlier[0] > 0


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(0, None, "k", 1.0), (0, None, "k", 1.0), (None, "", "k", 2.0), (2, "x" * 100_000, None, None)], "doc_id long, text string, _row string, p_toxic double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, none, CATEGORIES)
    assert got.columns == ["doc_id", "text", "_row", "p_low_quality", "p_toxic"] and got.count() == 4
    assert all(r.p_toxic < 0.01 for r in got.collect())
    assert toxicity.score(docs.limit(0), none, CATEGORIES).count() == 0


def test_language_by_evidence(spark):
    rng = random.Random(9)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40))
    en, fr = ["th", "er", "ing", "and"], ["eau", "oi", "qu", "é"]
    rows = [(i, make(en if i % 2 else fr), "en" if i % 2 else "fr", f"h{i % 4}", "x", 0.5) for i in range(80)]
    rows += [(100, make(fr), "en", "h0", "x", 0.5), (101, make(en), None, None, "x", 0.5), (102, "123 ***", "en", "h1", "x", 0.5), (103, None, "fr", "h0", "x", 0.5), (104, "", None, None, None, None)]
    rows += [rows[0], (None, make(en), "xx", "new", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _text string, posterior double")
    got = langid.identify(docs, "text", declared="lang", host="source")
    assert got.columns == ["doc_id", "text", "lang", "source", "_text", "language", "posterior", "language_accepted"]
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert all(found[i].language == ("en" if i % 2 else "fr") and found[i].language_accepted for i in range(80))
    assert found[100].language == "fr" and found[101].language == "en" and found[None].language == "en"
    assert [found[i].language for i in (102, 103, 104)] == [None] * 3 and not any(found[i].language_accepted for i in (102, 103, 104))
    assert langid.identify(docs.limit(0), "text", declared="lang").count() == 0
    without = langid.identify(docs.where("doc_id in (102, 103)"), "text", declared="lang", host="source")
    assert [r.language for r in without.collect()] == [None, None]
    assert langid.identify(docs, "text").where("language is not null").count() == 0


def test_host_prior_decides_where_text_is_thin(spark):
    rows = [(i, "zz", "aa" if i < 60 else "bb", "s", "left" if i < 60 else "right") for i in range(120)]
    rows += [(200, "zz", None, "s", "left"), (201, "zz", None, "s", "right")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, suffix string, host string")
    found = {r.doc_id: r.language for r in langid.identify(docs, "text", "lang", "suffix", "host").collect()}
    assert (found[200], found[201]) == ("aa", "bb")


def test_rare_languages_keep_their_name(spark):
    rng = random.Random(15)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40))
    parts = {f"l{k}": ["".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiou") for _ in range(2)) for _ in range(5)] for k in range(31)}
    rows = [(i, make(parts["l0"]), "l0", "hot") for i in range(1500)]
    rows += [(2000 + 10 * k + i, make(parts[f"l{k}"]), f"l{k}", f"h{i % 3}") for k in range(1, 31) for i in range(5)]  # each 0.3 % of the rows
    rows += [(5000 + k, make(parts[f"l{k}"]), None, None) for k in range(31)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in langid.identify(docs, "text", declared="lang", host="source").collect()}
    assert all(found[i].language == name and found[i].language_accepted for i, _, name, _ in rows if name)
    assert all(found[5000 + k].language == f"l{k}" for k in range(31))


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_CELLS", 2 * langid.BUCKETS)
    docs = spark.createDataFrame([(i, "some text", f"l{i % 3}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="declared languages"):
        langid.identify(docs, "text", declared="lang")

import random
import zlib

import pytest

from skyloom.llm import jaccard_join, line_dedup
from skyloom.llm.components import components
from tests.llm.helpers import deduped, documents, jaccard_components, prose


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near():
    rng = random.Random(10)
    rows, bases = [], [prose(rng, rng.randint(6, 90)) for _ in range(25)]
    for base in bases:
        rows += [edited(rng, base, rng.randint(0, 4)) for _ in range(rng.randint(1, 5))]
    chain = prose(rng, 100)  # each links with the next, the ends do not
    for _ in range(8):
        rows.append(chain)
        chain = edited(rng, chain, 2)
    hot = prose(rng, 60)
    rows += [edited(rng, hot, rng.randint(0, 3)) for _ in range(60)]  # one large group
    rows += [hot + " " + prose(rng, 15) for _ in range(40)]  # around the threshold
    rows += [prose(rng, 40) + " " + hot for _ in range(20)]  # a passage that unlike documents share
    for _ in range(12):  # texts inside much longer ones
        inner = prose(rng, 40, 10**6)
        rows += [inner, edited(rng, inner, 1), edited(rng, inner, 1), *(inner + " " + prose(rng, 200, 10**6) for _ in range(3))]
    rows += [None, "", " \n", "a b", "a b", "A  B", "a b c d e", "one", "w " * 300, "w " * 200]
    rng.shuffle(rows)
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(None if i % 97 == 5 else i, t) for i, t in zip(ids, rows, strict=True)]


def test_join_equals_all_pairs(spark, near):
    rows = near + near[:3] + [(near[0][0], near[1][1])]  # repeated rows, one id with two texts
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, e int, n int").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()), key=str)
    assert got == jaccard_components(rows)


@pytest.mark.parametrize("bits", [3, 9])
def test_sets_that_share_a_name_stay_apart(spark, near, bits):
    """So few bits that nearly all, or some, of the different sets have a name in common."""
    df = spark.createDataFrame(near, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(df, name_bits=bits).collect()), key=str)
    assert got == jaccard_components(near)


def test_groups_name_sets_in_reach_of_earlier_groups():
    groups = jaccard_join._Groups()
    # (shingle, set, size, largest size of its group, place): the second stands for a set of 135, which links with the last.
    for row in ((7, 1, 100, 100, 0), (7, 2, 110, 136, 0), (7, 3, 134, 134, 0), (7, 4, 179, 179, 44), (8, 5, 179, 179, 0), (8, 6, 250, 250, 0)):
        groups.meet(*row)
    assert set(groups.pairs) == {(1, 2), (3, 3), (4, 4)}
    assert [lead[3] for lead in groups.leaders] == [136, 134, 179, 179, 250]


def met_one_by_one(rows):
    """Pairs and leaders of (shingle, set, size, largest size, place) rows, taken singly."""
    pairs, leaders, shingle = set(), [], None
    for t, e, n, high, i in rows:
        if t != shingle:
            shingle, reach = t, high
            leaders.append([t, e, n, high, i])
            continue
        lead = leaders[-1]
        if 75 * n > 100 * lead[2]:
            if 75 * n <= 100 * reach:
                pairs.add((e, e))
            leaders.append([t, e, n, high, i])
        else:
            if e != lead[1]:
                can = 175 * (min(i, lead[4]) + min(n - i, lead[2] - lead[4])) >= 75 * (n + lead[2])
                pairs |= {(lead[1], e)} if can else {(lead[1], lead[1]), (e, e)}
            lead[3] = max(lead[3], high, lead[2] + 1)
        reach = max(reach, leaders[-1][3])
    return pairs, leaders


def test_groups_of_pieces_equal_those_of_single_rows():
    rng = random.Random(13)
    for _ in range(40):
        sizes = [rng.randint(1, 400) for _ in range(40)]
        rows = [(rng.randint(0, 6), e, n, n + rng.choice([0, n // 4]), rng.randint(0, n // 4)) for e, n in enumerate(sizes) for _ in range(rng.randint(1, 4))]
        rows.sort(key=lambda r: (r[0], r[2], r[1]))
        groups, at, pairs = jaccard_join._Groups(), 0, set()
        while at < len(rows):
            piece = rows[at : at + rng.randint(1, 60)]
            groups.meet(*zip(*piece, strict=True))
            pairs |= set(groups.pairs)
            at += len(piece)
        expected, leaders = met_one_by_one(rows)
        assert pairs == expected
        assert groups.leaders.tolist() == leaders


def test_outliers_of_a_large_group_make_few_pairs(spark, monkeypatch):
    """Texts just too far from a large group share prefix shingles with all of it, but are not paired with each of its texts."""
    rng = random.Random(14)
    base = prose(rng, 150, 10**6)
    rows = list(enumerate([edited(rng, base, 2) for _ in range(200)] + [edited(rng, base, 4) for _ in range(60)]))
    written = {}

    def as_table(df, label, keep=False, real=jaccard_join.as_table):
        table = real(df, label, keep)
        written[label] = written.get(label, 0) + table.count()
        return table

    monkeypatch.setattr(jaccard_join, "as_table", as_table)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()), key=str)
    assert got == jaccard_components(rows)
    assert len({c for _, _, c in got}) >= 20
    assert written["more-pairs"] < 8 * len(rows) and written["alive"] < 32 * len(rows)


def test_marks_never_rule_out_a_link(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng, pairs = np.random.default_rng(15), []
    for n in [1, 2, 3, 8, 50, 146, 700, 5000] * 12:
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        y = np.concatenate([x[: rng.integers(n // 2, n + 1)], rng.integers(0, 2**64, rng.integers(0, n // 3 + 2), dtype=np.uint64)])
        y = y if len(y) else x
        mx, my = jaccard_join._marks(np.concatenate([x, y]), np.array([0, n])).tolist()
        shared = len({*x.tolist()} & {*y.tolist()})
        pairs.append((n, len(y), mx, my, 100 * shared >= 75 * (n + len(y) - shared)))
    df = spark.createDataFrame(pairs, "nx long, ny long, mx array<long>, my array<long>, links boolean")
    got = df.select("nx", "links", jaccard_join._can_link(F.col("nx"), F.col("ny"), F.col("mx"), F.col("my")).alias("can")).collect()
    assert all(r["can"] for r in got if r["links"]) and sum(r["links"] for r in got) > 20
    assert sum(not r["can"] for r in got if not r["links"] and r["nx"] <= 146) > 5


def test_join_of_nothing(spark):
    assert jaccard_join.join(documents(spark, [])).count() == 0
    assert [tuple(r)[:3] for r in jaccard_join.join(documents(spark, [None, ""])).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 1)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(200, 201), (201, 200), (300, 300)]
    rng.shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 180)}, 201: 200}


def lines_of(rng, n):
    return [" ".join(f"v{rng.randrange(5000)}" for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_dedup_equals_comparing_all_runs(spark):
    rng = random.Random(12)
    shared = [lines_of(rng, rng.randint(3, 12)) for _ in range(6)]
    rows = []
    for doc in range(60):
        text = lines_of(rng, rng.randint(0, 4))
        for _ in range(rng.randint(0, 2)):
            run = rng.choice(shared)
            a = rng.randrange(len(run))
            text += run[a : rng.randint(a, len(run))] + [""] * rng.randint(0, 2) + lines_of(rng, rng.randint(0, 2))
        rows.append((doc, "\n".join(text)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "same line here\n" * 30), (104, rows[0][1]), (105, "a " * 3000 + "\nb")]
    for min_words in (12, 1):
        got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_words).collect()
        texts, removed = deduped(rows, min_words)
        for r in got:
            assert r.text == (None if r.doc_id == 100 else texts[r.doc_id]), (min_words, r.doc_id)
            assert r.removed_lines == removed[r.doc_id]
            assert r.emptied == (removed[r.doc_id] > 0 and not texts[r.doc_id].strip())


def test_dedup_of_odd_rows(spark):
    text = "\n".join(f"line number {i} of a text" for i in range(20))
    rows = [(None, text, 1, "k"), (5, text, 2, "k"), (5, text, 3, "k"), (6, text + "\nmore", 4, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed_lines int, _d string")
    got = {(r.doc_id, r._d): (r.text, r.emptied) for r in line_dedup.dedup(df).collect()}
    assert got == {(None, "k"): (text, False), (5, "k"): ("", True), (6, "k"): ("more", False)}
    assert line_dedup.dedup(df).count() == 4 and line_dedup.dedup(df.limit(0)).count() == 0


def test_counters_are_finer_than_a_million_and_keep_to_16_bits(spark):
    import numpy as np

    rows = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(40)) + " same five words in all") for i in range(300)], "doc_id long, text string")
    counters = jaccard_join._counters(jaccard_join._profiles(rows, jaccard_join._Names()))
    assert counters.dtype == np.uint16 and len(counters) >= 1 << 22
    assert counters.sum() == sum(len(r.text.split()) - 4 for r in rows.collect()) and counters.max() == 300
    assert zlib.decompress(jaccard_join._squeezed(np.array([2**33, 7]))) == np.array([2**32 - 1, 7], "<u4").tobytes()

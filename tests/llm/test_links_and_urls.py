import json
import math
import random

import pytest

from skyloom.llm import chat, url_filter

SCHEMA = {"find": {"q": {"type": "string", "maxLength": 5}, "n": {"type": "integer", "required": False}}, "set": {"on": {"type": "boolean"}, "to": {"type": "array", "required": False}}}


def linked(spark, calls, results):
    c = spark.createDataFrame([(*x, "extra") for x in calls], "conv_id long, call_id string, parents array<string>, tool string, arguments string, level string")
    r = spark.createDataFrame(results, "conv_id long, call_id string, place long, content string")
    return {(x.conv_id, x.call_id): x for x in chat.link(c, r, SCHEMA).collect()}


def test_links_levels_and_schemas(spark):
    got = linked(
        spark,
        [
            (1, "a", None, "find", '{"q": "x", "n": 3}'),
            (1, "b", ["a", "gone", "a"], "find", '{"n": 1.5, "q": "y"}'),
            (1, "c", ["b", "a"], "set", '{"to": [1, {"z": 1, "b": 2}], "on": true}'),
            (1, "d", ["e"], "find", '{"q": "toolong"}'),
            (1, "e", ["d"], "find", "not json"),
            (1, "f", ["e"], "other", "{}"),
            (2, "a", [], "find", None),
            (2, "b", [None], "set", '{"on": null}'),
            (2, "c", [], "find", '{"q": "x", "more": 1}'),
            (2, "c", [], "find", '{"q": "x", "more": 1}'),
            (None, "a", [], "find", "{}"),
        ],
        [(1, "a", 5, "later"), (1, "a", 2, 'say "hi"\n\\é'), (1, "zz", 1, None), (2, "a", None, "r"), (2, None, 1, "r")],
    )
    assert set(got) == {(1, x) for x in ("a", "b", "c", "d", "e", "f", "zz")} | {(2, x) for x in "abc"}
    assert {k[1]: v.level for k, v in got.items() if k[0] == 1} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": None, "zz": None}
    assert {k for k, v in got.items() if v.valid} == {(1, "a"), (1, "c")}
    assert {k for k, v in got.items() if v.linked} == {(1, "a"), (2, "a")}
    assert got[1, "a"].n_results == 2 and got[1, "zz"].tool is None
    one = json.loads(got[1, "a"].json)
    assert one == {"arguments": {"n": 3, "q": "x"}, "call_id": "a", "level": 0, "parents": [], "result": 'say "hi"\n\\é', "tool": "find", "valid": True}
    for row in got.values():
        assert json.dumps(json.loads(row.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == row.json
    assert '"arguments":{"on":true,"to":[1,{"b":2,"z":1}]}' in got[1, "c"].json
    assert json.loads(got[1, "e"].json)["arguments"] == "not json" and json.loads(got[2, "a"].json)["arguments"] is None


def test_levels_of_long_chains_and_graphs(spark):
    rng = random.Random(13)
    calls, want = [], {}
    for conv in range(12):
        for i in range(60):
            parents = [] if i == 0 else [i - 1] if conv < 4 else [i - 2] if conv < 6 and i > 1 else rng.sample(range(i), rng.randint(0, min(i, 2)))
            calls.append((conv, str(i), [*map(str, parents), "none"]))
            want[conv, str(i)] = max((want[conv, str(p)] + 1 for p in parents), default=0)
    calls += [(90, "a", ["b"]), (90, "b", ["c"]), (90, "c", ["a"]), (90, "d", ["a", "e"]), (90, "e", []), (90, "f", ["d"]), (90, "g", ["g"])]
    want |= {(90, x): 0 if x == "e" else None for x in "abcdefg"}
    got = chat.levels(spark.createDataFrame(calls, "conv_id long, call_id string, parents array<string>"))
    assert {(r.conv_id, r.call_id): r.level for r in got.collect()} == want


def test_no_calls(spark):
    assert linked(spark, [], []) == {}


def test_conversations_become_calls(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "r"), (1, 3, "user", None), (2, 0, "assistant", "alone"), (2, None, "user", "x"), (None, 0, "user", "x")]
    calls, results = chat.from_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.call_id: (r.tool, r.level, r.valid, r.linked) for r in chat.link(calls, results, chat.SCHEMAS).collect()}
    assert got == {"1-0": ("configure", 0, True, False), "1-1": ("answer", 1, True, True), "1-3": ("answer", 2, False, False), "2--1": (None, None, False, False)}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("https://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/"),
        ("http://example.net/fr/", "example.net", "/fr/", "net/"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None),
        ("x://example.com/de/?/", "example.com", "/de/", "example.com/de/"),
        ("http://ÀB.org#/fr/", "Àb.org", "", None),
        ("http://b.org/fr/x", "b.org", "/fr/x", "org/fr/"),
        ("http://b.net", "b.net", "", None),
        ("http://?a", "", "", None),
        ("no scheme", "", "", None),
        (None, "", "", None),
        ("a://b.org/://c", "b.org", "/://c", None),
    ],
)
def test_url_parts_and_rules(spark, url, host, path, rule):
    from pyspark.sql import functions as F

    h, p = url_filter.split_url(F.col("url"))
    got = spark.createDataFrame([(url,)], "url string").select(h.alias("h"), p.alias("p")).select("h", "p", url_filter.matching_rule(F.col("h"), F.col("p"), url_filter.RULES)).first()
    assert tuple(got) == (host, path, rule)


def test_segments_are_the_most_probable(spark):
    counts = {"cheap": 50, "pills": 40, "che": 5, "a": 100, "p": 3, "th": 60, "the": 90, "re": 20, "there": 30}
    runs = ["cheappills", "there", "theth", "zzz", "a" * 60]
    df = spark.createDataFrame([(r,) for r in runs], "run string")
    got = {r.run: r.words for r in url_filter.segment(df, spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got["cheappills"] == ["cheap", "pills"] and got["there"] == ["there"] and got["theth"] == ["the", "th"]
    assert got["zzz"] == ["zzz"] and "".join(got["a" * 60]) == "a" * 60


def test_segments_equal_all_cuts(spark):
    """Against the best of all ways to cut a run, with known words longer than any fixed bound."""
    rng = random.Random(4)
    letters = lambda k: "".join(rng.choice("ab") for _ in range(k))
    counts = {letters(rng.randint(1, 4)): rng.randint(1, 400) for _ in range(12)} | {"b" * 30: 9, "ab" * 20: 3}
    total = sum(counts.values())
    runs = sorted({letters(rng.randint(1, 11)) for _ in range(60)})

    def value(words):
        return sum(math.log(counts[w] / total) if w in counts else math.log(1 / total) - (len(w) - 1) * math.log(10) for w in words)

    def cuts(run):
        return [[run]] + [[*head, run[i:]] for i in range(1, len(run)) for head in cuts(run[:i])]

    df = spark.createDataFrame([(r,) for r in [*runs, "ab" * 20, "a" + "b" * 30, "zq" * 5000]], "run string")
    got = {r.run: r.words for r in url_filter.segment(df, spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    for run in runs:
        assert "".join(got[run]) == run and value(got[run]) == pytest.approx(max(map(value, cuts(run))), abs=1e-9)
    assert got["ab" * 20] == ["ab" * 20] and got["a" + "b" * 30][-1] == "b" * 30
    assert got["zq" * 5000] == ["zq" * 5000]


def test_bayes_blocks_what_goes_with_seed_words(spark):
    title = "<title>Cheap casino pills win garden tea house</title>"
    rows = [(i, f"http://casinowin{'x' * (i % 2)}.example.com/play/{i}", title) for i in range(30)]
    rows += [(100 + i, f"http://gardentea.example.com/house/{i}", title) for i in range(60)]
    rows += [(200, "http://win.example.com/play/9", title), (201, "http://teahouse.example.com/1", None), (202, None, None), (202, None, None), (203, "http://casino.example.net/en/", title)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.rule) for r in url_filter.judge(df).collect()}
    assert got[0] == got[200] == ("block", None) and got[100] == got[201] == got[202] == ("allow", None)
    assert got[203] == ("allow", "example.net/en/")
    assert url_filter.judge(df).count() == len(rows) and url_filter.judge(df.limit(0)).count() == 0

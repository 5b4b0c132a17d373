import hashlib
import heapq
import html
import random
import re
import zlib
from collections import defaultdict

import pytest

from skyloom.llm import html_text, repair

from .helpers import DATA, needs_data

# Pages.

PROSE = "Words of the article go on and on, as they do in prose. " * 4


def test_article_element_is_taken_whole():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
        "<div class='ad'>Buy this now, it is a long advert with many words in it, longer than an article's line.</div><article><h1>Title</h1><p><b>Bold\n start<br><p>"
        f"{PROSE}</p><p>Short.</p><p>caf&eacute; &amp; &#x41;&lt;tag&gt;</p><section id='comments'><p>A reader says {PROSE}</p></section></article><footer>&copy; us</footer>"
    )
    assert html_text.main_text(page) == f"Title Bold start {PROSE.strip()} Short. café & A<tag>"


def test_pages_without_an_article_element():
    menu = "<div><ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li></ul></div>"
    end = "<div><a href=x>Privacy</a> <a href=y>Terms</a></div>"
    page = f"<body>{menu}<div><h1>Title</h1><div>{PROSE}</div><div>Short.</div><div>{PROSE}</div></div>{end}</body>"
    assert html_text.main_text(page) == f"Title {PROSE}Short. {PROSE}".strip()
    page = f"<header><h1>Site</h1></header>{menu}<div id=content><h1>Title</h1><p>{PROSE}</p><p>Short.</p><div class='reader comments'><p>{PROSE}</p></div></div><aside>{PROSE}</aside>"
    assert html_text.main_text(page) == f"Title {PROSE}Short."
    assert html_text.main_text(f"<form><p>{PROSE}</p></form>") == PROSE.strip()  # a page that stands in a form as a whole


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just words &amp; more", "just words & more"),
        ("<nav>only a menu</nav><div class='ad'>and an advert</div><article> </article>", ""),
        ("<script>never closed <p>x", ""),
        ("<p>one<p>two<ul><li>three<li>four</ul>", "one two three four"),
        ("<p>whole</p><p>cut off</p><a hre", "whole cut off"),
        ("<p>a < b and &nosuch; &#0;</p>", "a < b and &nosuch; �"),
        ("<![unknown[x]]><p>text</p><!-- <p>gone</p> -->", "text"),
        ("<p>in<b>li</b>ne</p>", "inline"),
        ("<div style='display: none'>hidden</div><div hidden>too</div><p>seen</p>", "seen"),
    ],
)
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_no_markup_makes_the_parser_fail():
    rng = random.Random(3)
    bits = ["<", "</", ">", "<p>", "</p>", "<div class='ad'>", "</div>", "<!--", "-->", "<![", "]]>", "<!", "&amp;", "&#", "<script>", "</script>", "<a href=", "'", "text ", "<li>", "<article>", "<?", "<td>", "\x00", "<br/>", "<title>"]
    for _ in range(3000):
        html_text.main_text("".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))))


def test_smoothing_keeps_a_constant():
    assert html_text.smoothed(html_text.np.full(9, 3.0)).tolist() == pytest.approx([3.0] * 9)


def test_extract_of_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", "<p>x y</p>", 5, "t"), (1, "u", "<p>x y</p>", 5, "t"), (None, None, None, None, None), (2, "v", "", 0, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = sorted((tuple(r) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "x y", 3), (1, "u", "x y", 3), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0
    long = "<div><p>" + "words and more " * 200_000
    assert html_text.extract(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")).first()["n_chars"] == 15 * 200_000 - 1


@needs_data
def test_extract_equals_the_article_of_given_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == want


# Conversations.

WS = r"[^\x20\x09-\x0D]"


def uniform_cost(turns):
    """Cheapest, ASCII-least edits by uniform-cost search over whole role strings."""
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, edits, i, roles = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, edits
        if (i, roles) in seen or len(roles) > 2 * len(turns) + 2:
            continue
        seen.add((i, roles))
        for r in "ua":
            heapq.heappush(heap, (cost + 2, edits + "I", i, roles + r))
        if i < len(turns):
            initial, gone, cut = turns[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, roles))
            if not gone:
                heapq.heappush(heap, (cost + cut, edits + "K", i + 1, roles + initial))
                for r in "ua":
                    heapq.heappush(heap, (cost + 2 + cut, edits + "R", i + 1, roles + r))


def repaired_by_hand(rows):
    """The contract of the query on rows (conv_id, turn, role, text), ties of turn by role and text."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        space = lambda x: " " if x is None else str(x)
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()))
        seen, turns, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            last = re.findall(WS, text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = uniform_cost(turns)
        lines, i, roles = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else own[i][1:]
            i += edit != "I"
            if edit == "D":
                continue
            if edit in "IR":
                role = "assistant" if roles[-1:] == "u" else "user"
            roles += role[:1]
            lines.append(f"{role}:{text}")
        assert re.fullmatch(r"(s?(ua)+)?", roles)
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_cheapest_equals_uniform_cost_search(monkeypatch):
    rng = random.Random(0)
    some = lambda n: [(rng.choice(["s", "u", "a", "u", "a", " ", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]
    for _ in range(400):
        turns = some(rng.randrange(6))
        assert repair.cheapest(turns) == uniform_cost(turns)
    for _ in range(200):  # the windows change nothing
        turns = some(rng.randrange(10, 60))
        found = set()
        for window in (3, 16, 1000):
            monkeypatch.setattr(repair, "WINDOW", window)
            found.add(repair.cheapest(turns))
        assert len(found) == 1


def test_long_conversations_take_time_in_proportion():
    rng = random.Random(1)
    turns = [(rng.choice("uaaus"), rng.random() < 0.1, rng.random() < 0.1) for _ in range(30_000)]
    cost, audit = repair.cheapest(turns)
    assert len(audit) - audit.count("I") == len(turns) and cost > 0


def test_repair_of_every_case(spark):
    rng = random.Random(7)
    texts = ["Fine.", "Cut off", "", " \t\n", "Well? yes!", "x", "Same.", "ends. \n", None, "é ñ。", "z ", "." * 3]
    roles = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "tool", "", None]
    rows = []
    for conv in range(120):
        rows += [(conv, rng.choice([t, t, t, t + 3, None, 0]), rng.choice(roles), rng.choice(texts)) for t in range(rng.randrange(6))]
    rows += [(None, 0, "user", "Hello."), (None, None, None, None), (500, None, "user", "a."), (501, 2**62, "user", "a."), (501, -(2**62), "assistant", "b.")]
    rows += rows[:40]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in repair.damaged_and_repaired(df).collect()), key=str)
    assert got == repaired_by_hand(rows)


def test_repaired_rows_with_edits_and_clashing_columns(spark):
    rows = [(1, 0, "user", "Hi.", "x"), (1, 1, "user", "Hi.", "y"), (1, 2, "user", "Well", "z"), (1, 3, "tool", "", "z")]
    df = spark.createDataFrame(rows, SCHEMA + ", audit string")
    got = [(r.position, r.edit, r.turn, r.role, r.text) for r in repair.repair(df).orderBy("position").collect()]
    assert got == [(0, None, None, None, None), (1, "K", 0, "user", "Hi."), (2, "D", 1, None, None), (3, "R", 2, "assistant", "Well"), (4, "D", 3, None, None)]
    assert repair.damaged_and_repaired(df.limit(0)).count() == 0


@needs_data
def test_repair_of_given_conversations(spark):
    table = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = sorted((tuple(r) for r in repair.damaged_and_repaired(table).collect()), key=str)
    assert got == repaired_by_hand([tuple(r) for r in table.collect()])

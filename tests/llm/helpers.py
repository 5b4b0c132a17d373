"""Small tables and plain versions that the operators are held against."""

import os
import re
from collections import Counter, defaultdict

import pytest

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, ids=None):
    rows = [(i, t) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard_components(rows):
    """(doc_id, size, component) by comparing all pairs; ids may be null or repeated."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return sorted(((d, len(s), (min(least[find(i)]) if least[find(i)] else None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def word_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def deduped(rows, min_words):
    """Texts without later copies of line runs, by comparing every run of every text."""
    lines = {}
    for doc, text in sorted(rows):
        raw = (text or "").split("\n")
        lines[doc] = [(i, line, len(WORD.findall(line))) for i, line in enumerate(raw) if WORD.search(line)]
    first, gone = {}, set()
    for doc in sorted(lines):
        own = lines[doc]
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                if sum(w for _, _, w in own[a:b]) >= min_words:
                    key = tuple(line for _, line, _ in own[a:b])
                    if first.setdefault(key, (doc, a)) != (doc, a):
                        gone |= {(doc, i) for i in range(a, b)}
    out = {}
    for doc, text in rows:
        raw, own = (text or "").split("\n"), lines[doc]
        cut = set()
        for k, (i, _, _) in enumerate(own):
            if (doc, k) in gone:
                cut |= set(range(i, own[k + 1][0] if k + 1 < len(own) else len(raw)))
        out[doc] = "\n".join(line for i, line in enumerate(raw) if i not in cut)
    return out, Counter(doc for doc, _ in gone)

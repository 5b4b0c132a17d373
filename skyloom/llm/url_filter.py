"""URL filters: explicit rules first, then words of host and path judged by naive Bayes.

Names run together in a host are cut into words by a unigram Viterbi; the unigrams are
the words of all page titles. Everything is learnt and judged once for each distinct
host and path shape, so a host with a third of all pages is one row until the last join.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.shared import ascii_lower
from skyloom.session import as_table

#: host/path-prefix -> verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: A host or path with one of these words is an example of a page to block; fixed values.
SEEDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "warez")


def split_url(url):
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host, path, rules: dict[str, str]):
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def segment(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Most probable words of each distinct run of letters.

    ``runs``: column run. ``counts``: word and n, words of any length. An unknown piece of k letters has the
    probability of a word seen once, divided by 10 for each letter more than one.
    Returns run and words; the longest last word wins a tie.
    """
    seen = counts.agg(F.sum("n").alias("n"), F.array_sort(F.collect_set(F.length("word"))).alias("sizes")).first()
    total, sizes = float(seen["n"] or 1), F.array(*map(F.lit, seen["sizes"])).cast("array<int>")  # lengths of words, few
    starts = F.explode(F.sequence(F.lit(1), F.length("run")))
    pieces = runs.where("run <> ''").select("run", starts.alias("at"))
    fitting = F.filter(sizes, lambda k: k <= F.length("run") - F.col("at") + 1)
    pieces = pieces.select("run", "at", F.explode(fitting).alias("size"))
    pieces = pieces.withColumn("word", F.expr("substring(run, at, size)")).join(counts, "word")
    known = pieces.groupBy("run").agg(F.collect_list(F.struct("at", "size", "n")).alias("known"))  # bounded by one host's length
    every = runs.where("run <> ''").join(known, "run", "left")
    once, letter = math.log(1 / total), math.log(10)

    def words(run: str, known: list) -> list[str]:
        ending = [[] for _ in range(len(run) + 1)]
        for p in known or ():
            ending[p["at"] - 1 + p["size"]].append((p["size"], math.log(p["n"] / total)))
        best, last = [0.0], [0]
        strange, begun = -math.inf, 0  # the best way to here whose last piece is unknown, and where that piece begins
        for end in range(1, len(run) + 1):
            strange = strange - letter
            if best[end - 1] + once > strange:
                strange, begun = best[end - 1] + once, end - 1
            options = [(best[end - k] + weight, k) for k, weight in ending[end]]
            value, k = max([*options, (strange, end - begun)])
            best.append(value), last.append(k)
        out, end = [], len(run)
        while end:
            out.append(run[end - last[end] : end])
            end -= last[end]
        return out[::-1]

    def cut(batches):
        for batch in batches:
            runs = batch.column("run").to_pylist()
            found = [words(r, k) for r, k in zip(runs, batch.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["run", "words"])

    return every.mapInArrow(cut, "run string, words array<string>")


def _title_words(pages: DataFrame) -> DataFrame:
    title = ascii_lower(F.regexp_extract(F.coalesce("html", F.lit("")), "(?i)<title>([^<]*)", 1))
    words = pages.select(F.explode(F.regexp_extract_all(title, F.lit("[a-z]+"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """Judge every url: page_id, host, path, rule, score, verdict (allow or block).

    Takes page_id, url and html; extra columns are ignored and repeated rows repeated.
    A null url or one without ``://`` has an empty host and path, no words, and gets the
    verdict of the larger class. score: log odds of block by naive Bayes, trained on all
    pages with those that hold a seed word as examples of block. A null html has no title.
    The rule decides where one fits.
    """
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    shape = F.regexp_replace(ascii_lower(F.col("path")), "[0-9]+", "0")
    parsed = parsed.withColumns({"shape": shape, "rule": matching_rule(F.col("host"), F.col("path"), rules)})
    keys = as_table(parsed.groupBy("host", "shape").agg(F.count("*").alias("pages")), "url-keys")

    counts = _title_words(pages)
    hosts = keys.select("host").distinct()
    runs = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit("[a-z]+"), 0)).alias("pos", "run"))
    share = F.greatest(F.lit(1), F.sum("n") / 1000)  # a seed counts as one word in a thousand
    seed = pages.sparkSession.createDataFrame([(s,) for s in seeds], "word string").crossJoin(counts.agg(F.coalesce(share, F.lit(1.0)).cast("long").alias("n")))
    unigrams = as_table(counts.unionByName(seed).groupBy("word").agg(F.max("n").alias("n")), "unigrams")
    cut = as_table(segment(runs.select("run").distinct(), unigrams), "segments")
    words = runs.join(cut, "run").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("words"))
    tokens = F.concat(F.coalesce("words", F.array().cast("array<string>")), F.regexp_extract_all("shape", F.lit("[a-z0-9]+"), 0))
    marked = keys.join(words, "host", "left").select("host", "shape", "pages", tokens.alias("tokens"))
    bad = F.arrays_overlap("tokens", F.array(*map(F.lit, seeds))).cast("long")
    marked = as_table(marked.withColumn("bad", F.coalesce(bad, F.lit(0))), "url-tokens")

    n = F.col("pages")
    classes = marked.agg(F.sum(n * F.col("bad")).alias("b"), F.sum(n).alias("all")).first()
    prior = math.log((classes["b"] or 0) + 1) - math.log((classes["all"] or 0) - (classes["b"] or 0) + 1)
    each = marked.select("host", "shape", n, "bad", F.explode("tokens").alias("token"))
    table = each.groupBy("token").agg(F.sum(n * F.col("bad")).alias("b"), F.sum(n * (1 - F.col("bad"))).alias("a"))
    table = as_table(table, "token-counts")
    size = table.agg(F.count("*").alias("v"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a")).first()
    weight = F.log((F.col("b") + 1) / (size["b"] + size["v"])) - F.log((F.col("a") + 1) / (size["a"] + size["v"]))
    odds = each.join(table.select("token", weight.alias("w")), "token").groupBy("host", "shape").agg(F.sum("w").alias("w"))
    odds = as_table(odds, "url-odds")

    scored = parsed.join(odds, ["host", "shape"], "left").withColumn("score", F.round(F.coalesce("w", F.lit(0.0)) + prior, 9))
    by_rule = F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), F.col("rule"))
    verdict = F.coalesce(by_rule, F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", "score", verdict.alias("verdict"))

import duckdb
import pytest

from skyloom.llm.duck_sql import SQL
from skyloom.llm.queries import QUERIES
from tests.llm.helpers import DATA, needs_data


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got = QUERIES[name](spark, DATA)
    found = con.execute(SQL[name])
    order = [[c[0] for c in found.description].index(c) for c in got.columns]
    want = [tuple(row[i] for i in order) for row in found.fetchall()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@needs_data
def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "line_dedup", "ngram_jaccard_join", "best_fit_packing"]
    from skyloom.session import as_table
    from tests.llm.helpers import deduped, jaccard_components

    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if name != "language_id" else sorted(texts.items())
        docs = as_table(stage(spark, docs, DATA), name)
        if name == "best_fit_packing":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {d for d, _ in before}
            continue
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "line_dedup":
            want, removed = deduped(before, 50)
            assert after == {d: t for d, t in want.items() if not (removed[d] and not t.strip())}
        elif name == "ngram_jaccard_join":
            assert set(after) == {d for d, _, c in jaccard_components(before) if d == c}
        else:
            assert set(after) <= set(dict(before)) and len(after) > 0.9 * len(before)


def test_stages_take_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_group_stays(spark):
    from skyloom.llm.stages import near_duplicates_out

    words = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcd"]
    rows = [(None, words[0])] * 3 + [(None, words[0] + " more")]  # no member has an id
    rows += [(7, words[1]), (7, words[1] + " more"), (7, words[1]), (9, words[1]), (None, words[1])]  # one id, two linked texts
    rows += [(3, words[2]), (3, words[3])]  # one id, unlike texts
    rows += [(None, None), (None, " "), (5, ""), (5, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _kept int").repartition(3)
    got = [(r.doc_id, (r.text or "").split(" ")[0][:1]) for r in near_duplicates_out(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(None, "a"), (7, "b"), (3, "c"), (3, "d"), (None, ""), (None, ""), (5, "")], key=str)

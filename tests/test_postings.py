"""The kept index gives what a search over the records gives."""

import pytest
from pyspark.sql import functions as F

from scholia.operators import postings, retrieval
from scholia.sources import Store

RECORDS = {i: " ".join(w for j, w in enumerate(["flood", "river", "storm", "shelter", "climate", "people"]) if (i * 7 + j) % (j + 2) == 0) + f" own{i}" * (i % 3) for i in range(80)}
QUESTIONS = [(1, "flood and storm flood"), (2, "climate people shelter"), (3, "nothing known"), (4, "own4 river"), (5, "the of")]


def table(spark, records):
    return spark.createDataFrame(list(records.items()), "pos long, text string")


def rows(df):
    return sorted((r.query_id, r["rank"], r.pos, round(r.score, 9)) for r in df.collect())


@pytest.fixture
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, query string")


def test_after_changes(spark, tmp_path, questions):
    index, now = postings.Index(Store(spark, f"file://{tmp_path}/i", "pos", 4)), dict(RECORDS)
    index.update(table(spark, now), applied=("source", 0))
    for i in range(0, 80, 3):
        now[i] = "storm storm " + now[i]
    now[5], now[6], now[200] = None, "", "river people new"
    changed = {i: t for i, t in now.items() if RECORDS.get(i, 0) != t}
    index.update(table(spark, changed), applied=("source", 1))
    before = len(index.store.versions())
    index.update(table(spark, {1: "replayed"}), applied=("source", 1))
    assert len(index.store.versions()) == before
    for i in range(0, 80, 5):
        del now[i]
    index.update(table(spark, {1: now[1]}), spark.range(0, 80, 5).withColumnRenamed("id", "pos"))
    records = table(spark, now)
    whole = retrieval.phrase(records, questions, loose=False)
    expected = rows(retrieval.bm25(records, questions))
    assert rows(index.search(questions, whole=whole)) == expected
    total = index.totals().first()
    assert (total.n, total.size) == (len(now), sum(len(t.split()) for t in now.values() if t))
    index.compact()
    assert rows(index.search(questions, whole=whole)) == expected
    signed = index.store.read("inverted")
    assert signed.where("sign <> 1").count() == 0 and signed.count() == signed.select("term", "pos").distinct().count()
    found = {r.term: r.df for r in index.store.read("terms").collect()}
    assert found["river"] == sum("river" in t.split() for t in now.values() if t)


@pytest.mark.parametrize("k", [1, 3, 25])
def test_skipping_blocks(spark, tmp_path, questions, monkeypatch, k):
    monkeypatch.setattr(postings, "BLOCK", 4)
    index, records = postings.Index(Store(spark, f"file://{tmp_path}/i", "pos", 4)), table(spark, RECORDS)
    index.update(records)
    whole = retrieval.phrase(records, questions, loose=False)
    found = postings.pruned_search(index, questions, k, whole)
    assert rows(found.hits) == rows(index.search(questions, k, whole)) == rows(retrieval.bm25(records, questions, k))
    touched = {r.query_id: (r.n_all, r.n_touched) for r in found.touched.collect()}
    assert all(t <= n for n, t in touched.values()) and 5 not in touched
    if k == 1:
        assert sum(t for _, t in touched.values()) < sum(n for n, _ in touched.values())


def test_an_empty_index(spark, tmp_path, questions):
    index = postings.Index(Store(spark, f"file://{tmp_path}/i", "pos", 4))
    assert index.search(questions).count() == 0
    index.update(table(spark, RECORDS).limit(0))
    assert index.search(questions).count() == 0 and postings.pruned_search(index, questions).hits.count() == 0
    index.update(table(spark, {1: "flood"}))
    assert [r.pos for r in index.search(questions).collect()] == [1]


def test_a_long_exact_list_is_cut_to_what_counts(spark):
    """A question that every record holds: of records in no other list the first by pos come."""
    none = spark.createDataFrame([], "query_id long, pos long, score double, rank int")
    exact = spark.range(500).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("pos"), F.lit(1.0).alias("score"))
    vector = spark.createDataFrame([(1, 499, 0.5, 0)], "query_id long, pos long, score double, rank int")
    got = retrieval.fuse(vector, none, exact).orderBy("rank").collect()
    assert [r.pos for r in got] == [499, *range(29)]
    assert round(got[0].score, 9) == round(1 / 60 + 1 / 60 + 0.15, 9) and round(got[1].score, 9) == round(1 / 61 + 1 / 60 + 0.15, 9)


def test_terms_are_counted_without_a_shuffle(spark, tmp_path, questions):
    """And rows that share a pos are one record."""
    records = spark.createDataFrame([(1, "flood storm flood"), (1, "storm river"), (2, None)], "pos long, text string")
    assert "Exchange" not in postings.cut(records)._jdf.queryExecution().executedPlan().toString()
    index = postings.Index(Store(spark, f"file://{tmp_path}/i", "pos", 4))
    index.update(records)
    got = {r.pos: (r["size"], [(t.term, t.tf) for t in r.terms]) for r in index.store.read("forward").collect()}
    assert got == {1: (5, [("flood", 2), ("river", 1), ("storm", 2)]), 2: (0, [])}
    assert index.store.read("inverted").where("sign = 1").count() == 3

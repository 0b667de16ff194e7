"""Rules on small rows; expected values are worked out by hand or by plain Python."""

import re
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from scholia.operators import artifacts, catalog, chunking, clean, evidence, retrieval
from scholia.functions.text import tokens


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("step", "text", "expected"), [
    (clean.join_hyphens, "well-\n being", "wellbeing"),
    (clean.join_hyphens, "eco- nomics", "economics"),
    (clean.join_hyphens, "pre-   paredness", "preparedness"),
    (clean.join_hyphens, "pre-    paredness", "pre-    paredness"),
    (clean.join_hyphens, "a- bcd", "a- bcd"),
    (clean.join_hyphens, "ab- cd", "ab- cd"),
    (clean.drop_logos, "J E M body", " body"),
    (clean.drop_logos, "FL E E body", "FL E E body"),
    (clean.drop_page_numbers, "x\n12\n\ny", "x\n\ny"),
    (clean.drop_frontmatter, "ISSN 1234-5678\n\n\n\n\nbody", "\nbody"),
    (clean.drop_frontmatter, "ISSN 1234-5678\n\nISSN 1234-5678\n\n\nx", "\nx"),
    (clean.drop_ads, "US $10\nUS $20\nb\nc", "c"),
    (clean.cut_references, "a" * 50 + "\nReferences\nx", "a" * 50),
    (clean.cut_references, "a\nReferences\n" + "x" * 50, "a\nReferences\n" + "x" * 50),
    (clean.join_columns, "One\ntwo\n\nThree\n, four", "One two\n\nThree , four"),
    (clean.squeeze, "\n a  b\n\n\n\nc \n", "a b\n\nc"),
])
def test_cleaning_steps(spark, step, text, expected):
    assert one(spark, step, text) == expected


@pytest.mark.parametrize(("line", "heading"), [
    ("LITERATURE REVIEW", True), ("1 Introduction", True), ("1.2 Methods", True), ("Study Limitations", True), ("Hello", True), ("1. Introduction", False),
    ("Department of Health", False), ("ABC", False), ("Results.", False), ("Title,", False), ("ends with lower 1", False), ("One Two Three Four Five Six Seven Eight Nine", False),
])
def test_headings(spark, line, heading):
    assert one(spark, chunking.is_heading, line) is heading


def packed_plainly(lengths):
    done, first, size, overlap = [], 0, 0, 0
    for i, n in enumerate(lengths):
        if size + n > 2400 and size > 200:
            done.append((first, i - 1, overlap))
            k, total = 0, 0
            while k < i and total < 300:
                k, total = k + 1, total + lengths[i - k - 1] + 1
            first, overlap, size = i - k, i, total + n
        else:
            size += n + (1 if size else 0)
    return done + ([(first, len(lengths) - 1, overlap)] if size > 200 else [])


@pytest.mark.parametrize("lengths", [[100] * 100, [2500, 10, 2500, 10], [500, 900, 1200, 50, 40, 2000] * 5, [50], []])
def test_packing_of_sentences(spark, lengths):
    row = spark.createDataFrame([(lengths,)], "l array<int>").select(chunking.packed(F.col("l")).alias("x")).first()
    assert [tuple(r) for r in row.x] == packed_plainly(lengths)


@pytest.mark.parametrize(("at", "n", "sizes", "expected"), [(10, 5, [10, 0, 10], (3, 3)), (0, 10, [10, 0, 10], (1, 1)), (0, 30, [10, 0, 10], (1, 3)), (50, 5, [10, 0, 10], (1, 3)), (3, 3, [], (1, 1))])
def test_pages(spark, at, n, sizes, expected):
    row = spark.createDataFrame([(at, n, sizes)], "a long, n long, s array<long>").select(chunking.pages(F.col("a"), F.col("n"), chunking.running_sums(F.col("s"))).alias("x")).first()
    assert tuple(row.x) == expected


def test_chunks_cover_the_text(spark):
    text = " ".join(f"Sentence number {i} says something of its own." for i in range(300))
    rows = chunking.chunk(spark.createDataFrame([(7, text), (8, "short"), (9, None)], "doc_id long, text string"), "doc_id").collect()
    assert {r.doc_id for r in rows} == {7}
    assert sorted(r.chunk_id for r in rows)[0] == "7__chunk_0000"
    said = set(re.findall(r"number (\d+)", " ".join(r.text for r in rows)))
    assert said == {str(i) for i in range(300)}


def test_tokens(spark):
    assert one(spark, tokens, "Flood-risk, the U.S. 2020!") == ["flood-risk", "2020"]


def test_bm25(spark):
    records = spark.createDataFrame([(0, "flood risk flood"), (1, "risk"), (2, "storm surge")], "pos long, text string")
    questions = spark.createDataFrame([(1, "flood or risk")], "query_id long, query string")
    rows = {r.pos: round(r.score, 6) for r in retrieval.bm25(records, questions).collect()}
    assert rows == {0: 1.590851, 1: 0.606456}


def test_fusion(spark):
    v = spark.createDataFrame([(1, 10, 0.9, 0), (1, 20, 0.8, 1)], "query_id long, pos long, score double, rank int")
    b = spark.createDataFrame([(1, 20, 3.0, 0), (1, 30, 2.0, 1)], "query_id long, pos long, score double, rank int")
    e = spark.createDataFrame([(1, 30, 1.0)], "query_id long, pos long, score double")
    rows = {r.pos: round(r.score, 7) for r in retrieval.fuse(v, b, e).collect()}
    assert rows == {10: 0.0327957, 20: 0.0330601, 30: 0.1825225}


def test_phrase_without_long_words_keeps_all(spark):
    records = spark.createDataFrame([(0, "one"), (1, "two")], "pos long, text string")
    assert retrieval.phrase(records, spark.createDataFrame([(1, "is it ok")], "query_id long, query string")).count() == 2


def test_phrases_take_one_text_at_a_time():
    """A task's Python holds no more texts for a larger batch; a string's score without words is null."""
    questions = SimpleNamespace(value=("own", pa.array(["a", "b"]), [("a", "flood risk", ["flood"]), ("b", "is it", [])]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([f"{i} flood " * 2000 for i in range(1999)] + [None])], names=["pos", "t"])
    tracemalloc.start()
    n = 0
    for found in retrieval._matches(questions, loose=True)([batch]):
        n += len(found)
        assert set(found.to_pylist()[0].items()) <= {("query_id", "a"), ("query_id", "b"), ("pos", 0), ("pos", 1024), ("score", 1.0), ("score", None), ("whole", False)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2 * 1999 and peak < 5_000_000 < batch.nbytes / 5


def test_questions_beyond_the_bound(spark, monkeypatch):
    """Questions too large to broadcast give the same rows, as does a table over many partitions."""
    records = spark.createDataFrame([(i, f"flood number {i} in river", [float(i % 7), 1.0]) for i in range(60)], "pos long, text string, embedding array<float>").repartition(5)
    questions = spark.createDataFrame([(q, f"flood number {q}") for q in range(9)], "query_id long, query string")
    asked = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(9)], "query_id long, vector array<float>")
    run = lambda: [sorted(map(tuple, df.collect())) for df in (retrieval.dense(records, asked, 3), retrieval.phrase(records, questions))]
    small = run()
    monkeypatch.setattr(retrieval, "SENT", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(small[0]) == 27


def test_each_task_passes_on_its_best(spark):
    scored = spark.range(1000).selectExpr("id % 3 as query_id", "id as pos", "id * 0.5 as score")
    rows = retrieval.top(scored, 2)
    assert "WindowGroupLimit" in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.pos, r["rank"]) for r in rows.collect()) == [(0, 996, 1), (0, 999, 0), (1, 994, 1), (1, 997, 0), (2, 995, 1), (2, 998, 0)]


def test_cosine_of_unlike_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0])], "pos long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [(r.pos, r.score) for r in retrieval.dense(vectors, asked).orderBy("pos").collect()] == [(0, 1.0), (1, 0.0), (2, 0.0)]


@pytest.mark.parametrize(("text", "topic"), [("storm shelter", "flood-hazard"), ("shelter risk", "emergency-management"), ("hello", "general")])
def test_topics(spark, text, topic):
    assert one(spark, catalog.classify, text) == topic


def test_support(spark):
    rows = spark.createDataFrame([(0.025,), (0.0251,), (0.015,)], "s double").select(evidence.support_level(F.col("s")).alias("x")).collect()
    assert [r.x for r in rows] == ["partial", "direct", "weak"]


def test_upsert_again_changes_nothing(spark):
    old = spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], "id string, pos long, v int")
    new = spark.createDataFrame([("b", 0, 2), ("c", 1, 2)], "id string, pos long, v int")
    first = catalog.upsert(old, new, "id")
    assert sorted(map(tuple, first.collect())) == [("a", 0, 1), ("b", 1, 2), ("c", 3, 2)]
    assert sorted(map(tuple, catalog.upsert(first, new, "id").collect())) == sorted(map(tuple, first.collect()))


def test_report_percent(spark):
    raw = spark.createDataFrame([(1, "eco- nomics eco- nomics")], "doc_id long, text string")
    rows = {r.type: r for r in artifacts.corpus_report(raw, clean.clean(raw), "doc_id").collect()}
    assert (rows["hyphen_trailing_space"].raw, rows["hyphen_trailing_space"].removed, rows[None].percent) == (2, 2, 100)


def test_a_repeated_document_is_one_row_of_the_report(spark):
    """Its texts are counted together, and each row of the report's join is a document."""
    raw = spark.createDataFrame([(1, "well-\n being DOI: x"), (2, None)], "doc_id long, text string")
    cleaned = spark.createDataFrame([(1, "wellbeing"), (1, "in- tent ok"), (2, "")], "doc_id long, cleaned_text string")
    got = {r.doc_id: (r.raw, r.clean, r.improvement["hyphen_newline"]) for r in artifacts.document_report(raw, cleaned, "doc_id").collect()}
    assert got == {1: (4, 1, 2), 2: (None, 0, None)}


def test_long_lines_and_gates(spark):
    """Texts with what a gate looks for, in other cases and at the ends, are worked on as before."""
    texts = ["INFONNATION x", "SA-Weston y\nb", "a \n\n\n\nb\t\tc ", " J E M", "US $10\nb\nc\nd", "JOURNAL OF EMERGENCY MANAGEMENT Vol. 3 x"]
    got = clean.clean(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).orderBy("id").collect()
    assert [r.cleaned_text for r in got] == ["information x", "b", "a\n\nb c", "", "d", "x"]
    # A line of blank characters and one that Java's $ takes for a line break counts with its own length.
    line = "  \u0085"
    said = ["x" * 100, "Study Limitations", "y" * 300]
    rows = spark.createDataFrame([("\n".join([line, *said]),)], "t string").select(chunking.sections(F.col("t")).alias("s")).first().s
    assert [(r.heading, len(r.text)) for r in rows] == [("Study Limitations", 300)]


def test_cleanup_looks_at_a_line_once(spark):
    for step, said in ((clean.drop_frontmatter, "Published by"), (clean.drop_ads, "Back issues")):
        assert str(step(F.col("t"))).count(said) == 1


def test_cleanup_patterns_at_words_edges(spark):
    rows = [
        (clean.repair, "Flz.M aFlz.M Flz.Mx FLZ.M Flz.W.", "FRM aFlz.M Flz.Mx FLZ.M FRM."),
        (clean.repair, "constrnction constrnctions xconstrnctions constrnctionsx", "constructions constructions xconstrnctions constrnctionsx"),
        (clean.repair, "INNRMATION xinnrmation infonnation. Adequnte managcment_ managcment", "information xinnrmation information. adequate managcment_ management"),
        (clean.join_hyphens, "ab-  cde1 ab-  cde a-b- cdef _ab- cde q-\n x", "ab-  cde1 abcde a-b- cdef _ab- cde qx"),
        (clean.drop_logos, "A B C D xA B C D_ 1A B C", " xA B C D_ 1A B C"),
        (clean.drop_ads, "US $1\none\ntwo\nannual Subscription\nx\ny\nBack issue", "Back issue"),
        (clean.drop_frontmatter, "Doe, MD x\n\n \n\n\n\nkeep\nan Associate Professor", "\n\nkeep"),
    ]
    for step, text, expected in rows:
        assert spark.createDataFrame([(text,)], "t string").select(step(F.col("t"))).first()[0] == expected, (step, text)

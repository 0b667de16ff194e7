"""Runs of an ingest over what is there already."""

import time

import pytest
from pyspark.sql import functions as F

from scholia.functions.calls import timed
from scholia.functions.order import numbered
from scholia.operators import embedding, evidence, ingest
from scholia.sources import SCHEMAS, Store

AT, LATER = "2026-01-01", "2026-01-02"
PAGES = "document_id string, filename string, file_path string, page_texts array<string>, error string"


def said(name, n=30):
    return " ".join(f"Sentence number {i} of {name} says something of its own." for i in range(n))


def file(name, *pages, folder="in", error=None):
    return (name.replace(".", "_"), name, f"{folder}/{name}", list(pages) or None, error)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=4)


def run(spark, store, *files, at=AT, keep=True, **how):
    done = ingest.ingest(spark.createDataFrame(list(files), PAGES), ingest.load(store), F.lit(at).cast("timestamp"), **how)
    result, report = done.result.first(), {r.file_path: r for r in done.files.collect()}
    if keep:
        ingest.save(store, done, rebuild=how.get("rebuild", False))
    return result, report


def index(store):
    return {r.chunk_id: r for r in store.read("vectors", SCHEMAS["vectors"]).collect()}


def manifest(store):
    return {r.document_id: r for r in store.read("documents", SCHEMAS["documents"]).collect()}


def test_the_same_files_again(spark, store):
    files = [file("a.pdf", said("a")), file("b.pdf", said("b"))]
    first, _ = run(spark, store, *files)
    assert (first.success, first.documents, first.chunks, first.vectors) == (True, 2, 2, 2)
    before = index(store)
    again, report = run(spark, store, *files, at=LATER)
    assert (again.success, again.documents, again.chunks, again.vectors, again.n_errors, again.error) == (True, 2, 2, 0, 0, None)
    assert {r.state for r in report.values()} == {"known"} and index(store) == before
    assert {r.ingested_at.day for r in manifest(store).values()} == {1}
    assert store.read("raw").count() == 2 and store.read("clean").count() == 2


def test_files_that_cannot_be_read(spark, store):
    got, report = run(spark, store, file("a.pdf", said("a")), file("bad.pdf", error="damaged"))
    assert (got.success, got.documents, got.n_errors) == (True, 1, 1) and report["in/bad.pdf"].error == "PDF parse error: damaged"
    assert set(manifest(store)) == {"a_pdf"}
    only, _ = run(spark, store, file("bad.pdf", error="damaged"))
    assert not only.success and set(manifest(store)) == {"a_pdf"}


def test_no_files(spark, store):
    got, _ = run(spark, store)
    assert not got.success and got.n_errors == 1 and got.error == ingest.NO_FILES


def test_upload_takes_in_its_document_only(spark, store):
    run(spark, store, file("a.pdf", said("a", 400)), file("b.pdf", said("b")))
    before = index(store)
    assert len([c for c in before if c.startswith("a_pdf")]) > 3
    got, report = run(spark, store, file("a.pdf", said("new")), at=LATER, upload=True)
    assert (got.success, got.documents, got.chunks, got.vectors) == (True, 1, 1, 1)
    after = index(store)
    assert set(after) == {"a_pdf__chunk_0000", "b_pdf__chunk_0000"} and after["b_pdf__chunk_0000"] == before["b_pdf__chunk_0000"]
    assert "of new" in after["a_pdf__chunk_0000"].text and after["a_pdf__chunk_0000"].pos == before["a_pdf__chunk_0000"].pos
    assert {d: r.ingested_at.day for d, r in manifest(store).items()} == {"a_pdf": 2, "b_pdf": 1}
    assert all(not w.startswith("a.pdf") for w in report["in/a.pdf"].warnings)
    failed, _ = run(spark, store, file("a.pdf", error="damaged"), upload=True)
    assert not failed.success and index(store) == after and set(manifest(store)) == {"a_pdf", "b_pdf"}


def test_two_files_of_one_name(spark, store):
    got, report = run(spark, store, file("a.pdf", said("second"), folder="y"), file("a.pdf", said("first"), folder="x"))
    assert {p: r.state for p, r in report.items()} == {"x/a.pdf": "taken", "y/a.pdf": "repeated"}
    assert got.documents == 2 and "of first" in index(store)["a_pdf__chunk_0000"].text
    run(spark, store, file("a.pdf", said("second"), folder="y"), file("a.pdf", said("first"), folder="x"), rebuild=True)
    assert "of second" in index(store)["a_pdf__chunk_0000"].text


def test_all_anew(spark, store):
    run(spark, store, file("a.pdf", said("a")), file("b.pdf", said("b")))
    got, _ = run(spark, store, file("b.pdf", said("b")), at=LATER, rebuild=True)
    assert got.vectors == 1 and set(index(store)) == {"b_pdf__chunk_0000"} and set(manifest(store)) == {"b_pdf"}
    ingest.reset(store)
    assert not index(store) and not manifest(store) and store.read("chunks").count() == 0 and store.read("raw").count() == 2


def test_a_document_without_chunks_is_tried_again(spark, store):
    got, report = run(spark, store, file("a.pdf", "too short"))
    assert (got.success, got.documents, got.chunks) == (True, 0, 0) and ingest.NO_CHUNKS in report["in/a.pdf"].warnings[-1]
    _, report = run(spark, store, file("a.pdf", said("a")))
    assert report["in/a.pdf"].state == "taken" and len(index(store)) == 1


def test_failed_vectors_come_with_the_next_run(spark, store):
    def broken(texts):
        if any("of a " in t for t in texts):
            raise ValueError("no model")
        return embedding.letter_shares(texts)

    files = [file("a.pdf", said("a")), file("b.pdf", said("b"))]
    got, _ = run(spark, store, *files, embedder=broken)
    assert (got.success, got.documents, got.vectors, got.n_errors, got.error) == (True, 2, 1, 1, "Embedding failed: no model")
    assert set(index(store)) == {"b_pdf__chunk_0000"}
    got, _ = run(spark, store, *files)
    assert (got.vectors, got.error) == (1, None) and {c: r.pos for c, r in index(store).items()} == {"b_pdf__chunk_0000": 0, "a_pdf__chunk_0000": 1}


def test_calls_that_hang():
    def call(x):
        if x == 1:
            time.sleep(30)
        if x == 2:
            raise ValueError("broken")
        return x * 10

    began = time.monotonic()
    assert list(timed(call, [0, 1, 2, 3], 0.5, 2)) == [(0, None), (None, "timed out after 0.5 s"), (None, "broken"), (30, None)]
    assert time.monotonic() - began < 5


def test_embedding_that_hangs_or_raises(spark):
    made = []

    def connect():
        made.append(1)

        def call(texts):
            if "hang" in texts:
                time.sleep(60)
            return [[float(len(t)), float(len(made))] for t in texts if t != "lost"]

        return call

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", None, "lost", "bbb"])], "i int, text string").coalesce(1)
    got = {r.i: (r.embedding, r.embedding_error) for r in embedding.embed(rows, connect=connect, seconds=5).collect()}
    assert got == {0: ([2.0, 1.0], None), 1: ([0.0, 1.0], None), 2: (None, "0 vectors of 1 texts"), 3: ([3.0, 1.0], None)}
    hung = spark.createDataFrame([(0, "hang")], "i int, text string")
    assert embedding.embed(hung, connect=connect, seconds=0.5).first().embedding_error == "timed out after 0.5 s"


def test_answers_that_hang_or_raise(spark):
    asked = spark.createDataFrame([(1, "fine"), (2, "hang"), (3, "raise"), (4, "empty")], "query_id long, prompt string")

    def generate(prompt):
        if prompt == "hang":
            time.sleep(60)
        if prompt == "raise":
            raise ValueError("busy")
        return "" if prompt == "empty" else "said " + prompt

    got = {r.query_id: (r.answer, r.error) for r in evidence.answer(asked, generate, seconds=0.5).collect()}
    assert got == {1: ("said fine", None), 2: (None, "timed out after 0.5 s"), 3: (None, "busy"), 4: (None, evidence.EMPTY)}


def test_numbers_do_not_hang_on_partitions(spark):
    rows = [(f"k{i % 37}", i) for i in range(500)] + [(None, 900), ("k3", 901)]
    expected = {r: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])))}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "32"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = spark.createDataFrame(rows, "k string, i long").repartition(5)
            assert {(r.k, r.i): r.pos for r in numbered(df, ["k", "i"]).collect()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert numbered(spark.createDataFrame([], "k string, i long"), ["k"]).collect() == []

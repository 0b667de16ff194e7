"""Tables that are replaced safely, as a whole, by document and by stream."""

import pytest
from pyspark.sql import functions as F

from scholia.sources import Change, Conflict, Store, read_pages, upload_gate
from scholia.sources.files import MOST_BYTES, pdf_files, read_chunks, write_chunks
from scholia.streaming import ingest_stream, take_in

TEXT = " ".join(f"Sentence number {i} says something of its own." for i in range(30))


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, v string")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", "doc_id", 4)
    s.commit(Change("t", table(spark, *[(i, f"old {i}") for i in range(20)])))
    return s


def test_other_documents_stay(spark, store):
    store.commit(Change("t", table(spark, (3, "new a"), (3, "new b")), spark.createDataFrame([(3,), (4,)], "doc_id long")))
    assert rows(store.read("t")) == sorted([(i, f"old {i}") for i in range(20) if i not in (3, 4)] + [(3, "new a"), (3, "new b")])
    assert rows(store.read_document("t", 3)) == [(3, "new a"), (3, "new b")]
    assert rows(store.read_document("t", 4)) == []
    assert rows(store.read("t", version=0)) == sorted((i, f"old {i}") for i in range(20))


def test_untouched_buckets_are_not_written(spark, store):
    before = store.snapshot()["tables"]["t"]["live"]
    store.commit(Change("t", table(spark, (3, "new")), spark.createDataFrame([(3,)], "doc_id long")))
    after = store.snapshot()["tables"]["t"]["live"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1


def test_replay_changes_nothing(spark, store):
    change = Change("t", table(spark, (3, "new")), spark.createDataFrame([(3,)], "doc_id long"))
    first = store.commit(change, applied=("stream", 7))
    assert store.commit(Change("t", table(spark, (3, "other"))), applied=("stream", 7)) == first
    assert rows(store.read_document("t", 3)) == [(3, "new")] and len(store.versions()) == 2
    assert store.commit(change, applied=("another", 0)) == first + 1


def test_failure_before_the_switch(spark, store, monkeypatch):
    """What was written before a failure isn't seen, and goes with the next clean-up."""
    before = rows(store.read("t"))

    def fail(snapshot):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_switch", fail)
    with pytest.raises(RuntimeError):
        store.commit(Change("t", table(spark, (3, "new"))), applied=("stream", 1))
    monkeypatch.undo()
    assert rows(store.read("t")) == before and store.snapshot()["applied"] == {}
    assert len(store.vacuum()) == 1
    assert rows(store.read("t")) == before


def test_failed_task_leaves_the_old_state(spark, store):
    before = rows(store.read("t"))
    bad = table(spark, (3, "x")).withColumn("v", F.raise_error(F.lit("bad row")).cast("string"))
    with pytest.raises(Exception, match="bad row"):
        store.commit(Change("t", bad, spark.createDataFrame([(3,)], "doc_id long")), Change("u", table(spark, (1, "a"))))
    assert rows(store.read("t")) == before and "u" not in store.snapshot()["tables"]


def test_tables_change_together(spark, store):
    store.commit(Change("t", table(spark, (1, "a"))), Change("u", table(spark, (1, "b"))))
    assert rows(store.read("t")) == [(1, "a")] and rows(store.read("u")) == [(1, "b")]
    store.reset("t")
    assert rows(store.read("t")) == [] and rows(store.read("u")) == [(1, "b")]
    assert store.read("t").columns == ["doc_id", "v"]


def test_appended_rows_join_their_buckets(spark, store):
    store.commit(Change("t", table(spark, (3, "more"), (99, "more")), append=True))
    assert rows(store.read_document("t", 3)) == [(3, "more"), (3, "old 3")]
    assert store.read("t").count() == 22
    store.commit(Change("t", table(spark, (3, "last")), spark.createDataFrame([(3,)], "doc_id long")))
    assert rows(store.read_document("t", 3)) == [(3, "last")] and store.read("t").count() == 21


def test_two_writers(spark, store):
    slow = store.snapshot()
    store.commit(Change("t", table(spark, (1, "a"))))
    with pytest.raises(Conflict):
        store._switch({**slow, "version": slow["version"] + 1})
    assert rows(store.read("t")) == [(1, "a")]


def test_clean_up_keeps_what_is_named(spark, store):
    for i in range(3):
        store.commit(Change("t", table(spark, (i, "x")), spark.createDataFrame([(i,)], "doc_id long")))
    now = rows(store.read("t"))
    store.vacuum(keep=1)
    assert store.versions() == [3] and rows(store.read("t")) == now


def test_empty_and_missing(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/new", "doc_id")
    assert s.read("t", "doc_id long, v string").count() == 0 and s.versions() == []
    s.commit(Change("t", table(spark)))
    assert s.read("t").count() == 0
    s.commit(Change("t", table(spark, (None, "n"), (1, "a")), spark.createDataFrame([(1,)], "doc_id long")))
    assert s.read("t").count() == 2


def test_streamed_batches(spark, tmp_path):
    """A later file replaces its own documents and keeps the others; one without chunks now has none."""
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    run = lambda: ingest_stream(spark, folder, "doc_id long, text string", out, check).awaitTermination()
    said = lambda: {r.doc_id: r.text for r in Store(spark, out, "doc_id").read("chunks").collect()}
    spark.createDataFrame([(1, TEXT), (2, TEXT)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)
    run()
    assert set(said()) == {1, 2}
    spark.createDataFrame([(2, TEXT.replace("own", "other")), (3, TEXT)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)
    run()
    assert set(said()) == {1, 2, 3} and "other" in said()[2] and "other" not in said()[1]
    spark.createDataFrame([(1, "short now")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)
    run()
    assert set(said()) == {2, 3}


def test_streamed_batch_again(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "doc_id")
    twice = spark.createDataFrame([(1, TEXT, 1), (1, TEXT.replace("own", "second"), 2), (5, None, 1)], "doc_id long, text string, at int")
    first = take_in(store, twice, "source", 0, "at")
    held = rows(store.read("chunks").select("doc_id", "chunk_id", "text"))
    assert {r[0] for r in held} == {1} and "second" in held[0][2]
    assert take_in(store, twice, "source", 0, "at") == first and rows(store.read("chunks").select("doc_id", "chunk_id", "text")) == held


def test_files(spark, tmp_path):
    (tmp_path / "a b.pdf").write_bytes(b"one|two")
    (tmp_path / "bad.pdf").write_bytes(b"!")
    (tmp_path / "note.txt").write_bytes(b"x")
    files = pdf_files(spark, str(tmp_path))
    assert files.count() == 2

    def extract(content):
        if content == b"!":
            raise ValueError("damaged")
        return content.decode().split("|")

    found = {r.document_id: r for r in read_pages(files, extract).collect()}
    assert found["a_b_pdf"].page_texts == ["one", "two"] and found["a_b_pdf"].full_text == "\n\none\n\ntwo" and found["a_b_pdf"].filename == "a b.pdf"
    assert found["bad_pdf"].page_texts is None and found["bad_pdf"].error == "damaged" and found["bad_pdf"].file_path.endswith("/bad.pdf")
    gate = [(("x.pdf", 1, "text/plain"), True), (("x.PDF", 1, "application/pdf"), True), (("x.txt", 1, "text/plain"), False), (("x.pdf", MOST_BYTES + 1, "application/pdf"), False)]
    given = spark.createDataFrame([g for g, _ in gate], "p string, n long, k string")
    assert [r.ok for r in given.select(upload_gate(F.col("p"), F.col("n"), F.col("k")).alias("ok")).collect()] == [ok for _, ok in gate]


def test_chunk_files(spark, tmp_path):
    one = spark.createDataFrame([("d__chunk_0000", "d", "f.pdf", 1, 2, None, "text", ["flag"], [])], "chunk_id string, document_id string, source_file string, page_start int, page_end int, section_path string, text string, cleaning_flags array<string>, quality_notes array<string>")
    write_chunks(one, str(tmp_path / "c"))
    (tmp_path / "c" / "more.json").write_text("\n\n")
    assert read_chunks(spark, str(tmp_path / "c")).collect() == one.collect()
    (tmp_path / "c" / "broken.json").write_text('{"chunk_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_chunks(spark, str(tmp_path / "c")).collect()

"""The pipeline on the smallest tables: stages keep columns and only drop or shorten."""

import os

import numpy as np
import pytest

import corpus_pipeline
from scholia.llm import decontaminate, simhash

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, now = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, now, DATA)
        assert kept.columns == columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in now.select("doc_id").collect()}
        now = spark.createDataFrame(kept.collect(), kept.schema)
    assert decontaminate.find_contamination(now, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").count() == 0
    marks = [r.fingerprint for r in simhash.near_duplicates(now).collect()]
    assert len(set(marks)) == len(marks)
    got = corpus_pipeline.run(spark, DATA)
    assert got.select("doc_id").distinct().count() == now.count()


def test_near_dedup_stage(spark):
    """Of texts that share four fifths of their runs of five words, one stays."""
    words = [f"w{i}" for i in range(200)]
    texts = [(1, " ".join(words)), (2, " ".join([*words[:97], "x", "y", *words[99:]])), (3, " ".join(words[::-1]))]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(texts, "doc_id long, text string"), DATA)
    assert {r.doc_id for r in kept.collect()} == {1, 3}


def test_fingerprints_of_sets():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n, np.uint64) for n in (1, 2, 7, 300, 1, 40)]
    at = np.cumsum([0, *map(len, sets[:-1])])
    bits = [np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1) for s in sets]
    expected = [np.packbits(2 * b.sum(0, dtype=int) > len(b)).view(np.uint64)[0] for b in bits]
    for width in (1, 8, 1 << 15):
        assert simhash.set_fingerprints(np.concatenate(sets), at, width).tolist() == expected


def test_the_embedding_proposes_near_copies(spark):
    """Sets within two bits are compared though they share no sample; those further apart aren't."""
    cells, like = "row long, n long, fp long, cells array<long>", list(range(20))
    nodes = [(0, 20, 0, []), (1, 20, 3, []), (2, 20, 0, []), (3, 20, 0x70, []), (4, 20, 3 << 40, []), (5, 0, 0, [])]
    sets = [(0, like), (1, like[1:]), (2, like[2:]), (3, like), (4, [99, 98]), (5, [])]
    links = simhash.link_sets(spark.createDataFrame(nodes, cells), spark.createDataFrame(sets, "row long, shingles array<int>"), 0.8)
    assert {frozenset((r.a, r.b)) for r in links.collect()} == {frozenset((0, 1)), frozenset((0, 2))}

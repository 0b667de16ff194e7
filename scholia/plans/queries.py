"""The registered queries: each applies an operator to whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.text import tokens
from scholia.operators import artifacts, catalog, chunking, clean, embedding, evidence, ingest, postings, retrieval
from scholia.sources import Change, Store, shared_dir

from .oracle import ORACLE_SQL, noised

FLAGSHIP = "hybrid_retrieval"
QUERIES: dict = {}
#: Tables whose rows take long enough for that, and bytes of their file that are a task's at most.
WORKED_ON, TASK = {"documents", "embeddings"}, 4 << 20


def query(f):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that is worked on and comes in a single file is spread over the cores,
    and over as many tasks more as its size asks for, so that none grows with the table.
    A table of many files is read as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in WORKED_ON or len(df.inputFiles()) != 1:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-size // TASK)))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions' vectors: those with their number."""
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.join(_questions(spark, sf_dir).select("query_id"), "query_id", "left_semi")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, as one-page records."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text", "source")
    return docs.withColumns({"page_start": F.lit(1), "page_end": F.lit(1), "section_path": F.lit(None).cast("string"), "cleaning_flags": F.array().cast("array<string>")})


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of documents."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("pos"))
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding").join(ids, "pos", "left_semi")


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return _records(spark, sf_dir), _vectors(spark, sf_dir), _questions(spark, sf_dir), _asked(spark, sf_dir)


def _noised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.expr(noised()).alias("text"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid(*_searched(spark, sf_dir))


def _ranked(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.select("query_id", F.col("pos").alias(name), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


@query
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "documents").select(tokens(F.col("text")).alias("t"))
    return t.agg(F.count("*").alias("n_docs"), F.round(F.avg(F.size("t")), 6).alias("mean_terms"), F.sum(F.size(F.array_distinct("t"))).cast("long").alias("n_postings"))


@query
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(retrieval.bm25(_documents(spark, sf_dir), _questions(spark, sf_dir)))


def _changed_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents of low quality with their texts twice over, and those that are toxic."""
    labels = _read(spark, sf_dir, "labels")
    of = lambda rule: labels.where(rule).select(F.col("doc_id").alias("pos")).distinct()
    changed = _documents(spark, sf_dir).join(of("quality = 0"), "pos", "left_semi").select("pos", F.concat("text", F.lit(" "), "text").alias("text"))
    return changed, of("toxic = 1")


def _index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """An index of all documents that was changed twice: by new texts, then by deletions."""
    index, (changed, gone) = postings.Index(_store(spark, "pos")), _changed_records(spark, sf_dir)
    index.update(_documents(spark, sf_dir))
    index.update(changed)
    index.update(changed.limit(0), gone)
    return index


def _final_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index then holds."""
    changed, gone = _changed_records(spark, sf_dir)
    return _documents(spark, sf_dir).join(changed.select("pos"), "pos", "left_anti").unionByName(changed).join(gone, "pos", "left_anti")


@query
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = retrieval.phrase(_final_records(spark, sf_dir), _questions(spark, sf_dir), loose=False)
    return _ranked(_index(spark, sf_dir).search(_questions(spark, sf_dir), whole=whole))


@query
def bm25_index_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a boost for whole questions."""
    index = _index(spark, sf_dir)
    index.compact()
    return _ranked(index.search(_questions(spark, sf_dir)))


def _plain_index(spark: SparkSession, sf_dir: str) -> postings.Index:
    index = postings.Index(_store(spark, "pos"))
    index.update(_documents(spark, sf_dir))
    return index


@query
def bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = retrieval.phrase(_documents(spark, sf_dir), _questions(spark, sf_dir), loose=False)
    return _ranked(postings.pruned_search(_plain_index(spark, sf_dir), _questions(spark, sf_dir), whole=whole).hits)


@query
def bm25_pruned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many postings a search for the best three adds up, of how many."""
    return postings.pruned_search(_plain_index(spark, sf_dir), _questions(spark, sf_dir), k=3).touched


@query
def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    return _ranked(retrieval.dense(vectors, _asked(spark, sf_dir)), "vec_id")


@query
def phrase_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.phrase(_documents(spark, sf_dir), _questions(spark, sf_dir))
    return found.select("query_id", F.col("pos").alias("doc_id"), F.round("score", 6).alias("score"))


@query
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(retrieval.fuse(*retrieval.lists(*_searched(spark, sf_dir))))


@query
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    return _ranked(hits).withColumn("retrieval_method", F.lit("hybrid-rrf"))


@query
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.sources(_hits(spark, sf_dir))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("pos").alias("doc_id"), "source", "support_level", F.md5("snippet").alias("snippet_md5"))


def _judged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("warnings", F.array_join("warnings", "|"))


@query
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(evidence.confidence(_hits(spark, sf_dir), _questions(spark, sf_dir)))


@query
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a model that gives the first sentence of its evidence."""
    hits = retrieval.kept(_hits(spark, sf_dir))
    return _judged(evidence.respond(hits, _questions(spark, sf_dir)))


@query
def confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a log with a report for each question."""
    rows = evidence.confidence(_hits(spark, sf_dir), _questions(spark, sf_dir))
    return catalog.confidence_counts(rows, "confidence")


@query
def evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.confidence(_hits(spark, sf_dir), _questions(spark, sf_dir))
    return rows.select("query_id", evidence.evidence_quality(F.col("confidence")).alias("evidence_quality"))


@query
def retrieval_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, vectors, questions, asked = _searched(spark, sf_dir)
    vector, lexical, exact = retrieval.lists(records, vectors, questions, asked)
    fused = retrieval.kept(retrieval.fuse(vector, lexical, exact))
    hits = retrieval.best_evidence(retrieval.rerank(fused, records, questions), 5)
    stages = {"dense": vector, "lexical": lexical, "exact": exact, "fused": fused, "hits": hits}
    rows = None
    for name, df in stages.items():
        one = df.select("query_id", F.lit(name).alias("stage"))
        rows = one if rows is None else rows.union(one)
    counts = rows.groupBy("query_id").agg(*[F.count_if(F.col("stage") == s).alias(f"n_{s}") for s in stages])
    return questions.select("query_id").join(counts, "query_id", "left").select("query_id", *[F.coalesce(f"n_{s}", F.lit(0)).cast("long").alias(f"n_{s}") for s in stages])


@query
def clean_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps but the folds over lines."""
    rows = clean.clean(_noised(spark, sf_dir), skip=clean.FOLDS)
    return rows.select("doc_id", F.md5("cleaned_text").alias("cleaned_md5"), F.length("cleaned_text").cast("long").alias("n_chars"))


@query
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.clean(_noised(spark, sf_dir))
    return rows.select("doc_id", F.md5("cleaned_text").alias("cleaned_md5"), F.array_join("cleaning_flags", ",").alias("cleaning_flags"), F.array_join("quality_notes", ",").alias("quality_notes"))


@query
def artifact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.scan(_noised(spark, sf_dir)).select("doc_id", *artifacts.PATTERNS)


@query
def artifact_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first places of each pattern in each document."""
    rows = _noised(spark, sf_dir)
    shown = [F.array_join(artifacts.examples(F.col("text"), p), "|").alias(k) for k, p in artifacts.PATTERNS.items()]
    return rows.select("doc_id", *shown)


@query
def artifact_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = artifacts.scan(_noised(spark, sf_dir))
    return rows.select("doc_id", F.round("noise_ratio", 6).alias("noise_ratio"), F.round(artifacts.chunk_noise(F.col("noise_ratio")), 6).alias("chunk_noise"))


@query
def artifact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _noised(spark, sf_dir)
    return artifacts.corpus_report(raw, clean.clean(raw), "doc_id")


@query
def artifact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report by document, with file names."""
    raw = _noised(spark, sf_dir)
    names = _read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".pdf")).alias("filename"))
    rows = artifacts.document_report(raw, clean.clean(raw), "doc_id", names)
    return rows.select("doc_id", "filename", "raw", "clean", "removed", "percent", F.element_at("improvement", "hyphen_newline").alias("hyphens"))


@query
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "documents").select("doc_id", chunking.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\x01")).alias("sentences_md5"))


@query
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(F.filter("l", chunking.is_heading)).cast("long").alias("n_headings"))


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("text") / 2)
    docs = clean.clean(_noised(spark, sf_dir)).withColumn("page_sizes", F.array(half, F.length("text") - half))
    rows = chunking.chunk(docs.select("doc_id", F.col("cleaned_text").alias("text"), "page_sizes"), "doc_id", "text", "page_sizes")
    return rows.select("doc_id", "chunk_id", "section_path", "page_start", "page_end", F.md5("text").alias("text_md5"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of two pages; those of less than 200 characters can't be read."""
    rows = _read(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(noised()).alias("t"), "n_chars")
    half = F.floor(F.length("t") / 2).cast("int")
    pages = F.when(F.col("n_chars") >= 200, F.array(F.left("t", half), F.substring("t", half + 1, F.length("t"))))
    return rows.select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), "lang", pages.alias("page_texts"), F.lit("no pages").alias("error"))


def _at(day: str) -> Column:
    return F.lit(day).cast("timestamp")


def _ingested(spark: SparkSession, sf_dir: str) -> ingest.Ingest:
    """Everything taken in anew."""
    return ingest.ingest(_pages(spark, sf_dir), ingest.no_tables(spark), _at("2026-01-01"), rebuild=True)


def _store(spark: SparkSession, key: str = "document_id") -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", key)


def _ingested_twice(spark: SparkSession, sf_dir: str) -> ingest.Ingest:
    """The English documents taken in and saved, then all of them."""
    store, pages = _store(spark), _pages(spark, sf_dir)
    ingest.save(store, ingest.ingest(pages.where("lang = 'en'"), ingest.load(store), _at("2026-01-01")))
    return ingest.ingest(pages, ingest.load(store), _at("2026-01-02"))


@query
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ingested(spark, sf_dir).files
    return rows.select("document_id", "filename", F.col("page_count").cast("long").alias("page_count"), F.col("chunk_count").cast("long").alias("chunk_count"), "status", "error", F.array_join("cleaning_flags", ",").alias("flags"), F.array_join("warnings", "|").alias("warnings"))


@query
def ingest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after it: each chunk with its place and vector, of which the sum stands here."""
    rows = _ingested(spark, sf_dir).tables.index
    return rows.select("pos", "chunk_id", "document_id", "source_file", "page_start", "page_end", F.md5("text").alias("text_md5"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("vector_sum"))


@query
def ingest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).result.drop("error")


@query
def ingest_again_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the second of two runs, the first of which took in the English documents."""
    return _ingested_twice(spark, sf_dir).result.drop("error")


@query
def ingest_again_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ingested_twice(spark, sf_dir).tables.manifest
    return rows.select("document_id", "filename", "page_count", "chunk_count", F.to_date("ingested_at").cast("string").alias("day"), "status", F.array_join("cleaning_flags", ",").alias("flags"))


@query
def ingest_again_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested_twice(spark, sf_dir).tables.index.select("pos", "chunk_id", F.md5("text").alias("text_md5"))


@query
def ingest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each file of the second run."""
    return _ingested_twice(spark, sf_dir).files.select("document_id", "state", "page_count", "chunk_count", F.size("warnings").cast("long").alias("n_warnings"))


@query
def store_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all documents, in which those of low quality are replaced, a third of them by nothing."""
    store, docs = _store(spark, "doc_id"), _read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("mark"))
    store.commit(Change("marks", docs), applied=("load", 0))
    low = _read(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    new = docs.join(low, "doc_id", "left_semi").where("left(mark, 1) >= '5'").select("doc_id", F.concat(F.lit("new "), "mark").alias("mark"))
    for _ in range(2):  # the second time it is a replay
        store.commit(Change("marks", new, low), applied=("load", 1))
    return store.read("marks")


@query
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding.embed(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.floor(x * 10000 + 0.5).cast("long").cast("string")), ",").alias("vector"))


@query
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages").select(catalog.document_id(F.col("url")).alias("document_id"), F.col("url").alias("filename"))
    return catalog.document_list(rows, "1")


@query
def reset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store whose index is reset: what its tables hold before and after."""
    store = _store(spark, "vec_id")
    store.commit(Change("vectors", _read(spark, sf_dir, "embeddings")), Change("raw", _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")))
    store.reset("vectors")
    rows = None
    for table in ("raw", "vectors"):
        for state, version in (("before", 0), ("after", 1)):
            one = store.read(table, version=version).agg(F.count("*").alias("n")).select(F.lit(table).alias("table"), F.lit(state).alias("state"), "n")
            rows = one if rows is None else rows.unionByName(one)
    return rows


@query
def report_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of the users' turns, with the assistants' put before them."""
    rows = _read(spark, sf_dir, "conversations")
    said = rows.select("role", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.md5("text")).alias("question"))
    log = said.where("role = 'user'").select(F.concat(F.lit("old_"), "question").alias("id"), "question", F.lit("2025-01-01").cast("timestamp").alias("created_at"))
    after = catalog.append_report(log, said.where("role <> 'user'").select("question"), F.lit("2026-01-01").cast("timestamp"))
    return after.select("question", F.to_date("created_at").cast("string").alias("day"), F.col("id").startswith("report_1767225600000").alias("stamped"))


@query
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", catalog.document_id(F.col("url")).alias("document_id"))


@query
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(_read(spark, sf_dir, "documents"), "source", "doc_id").select("source", F.col("doc_id").cast("long").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"))


@query
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    old = vectors.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), "label")
    new = vectors.where("vec_id % 3 = 0").select((F.col("vec_id") + 100).alias("id"), F.col("vec_id").alias("pos"), F.lit(-1).alias("label"))
    return catalog.upsert(old, new, "id")


@query
def embed_only_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return catalog.only_new(_read(spark, sf_dir, "documents").select("doc_id"), index, "doc_id")


@query
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _read(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"))
    return catalog.delete_documents(_read(spark, sf_dir, "embeddings").select("vec_id", "label"), gone, "vec_id")


@query
def catalog_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunk_count"))
    last = _read(spark, sf_dir, "events").agg(F.max("ts").alias("ingested_at"))
    return catalog.status(manifest.crossJoin(last), _read(spark, sf_dir, "embeddings"))


@query
def status_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status before anything is taken in, the pages being the files that wait."""
    tables = ingest.no_tables(spark)
    row = catalog.status(tables.manifest, tables.index, _read(spark, sf_dir, "pages"), _read(spark, sf_dir, "pages").where("url like '%1%'"))
    return row.select("documents", "vectors", "ready", F.array_join("notes", "|").alias("notes"))


@query
def chunk_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.preview(_read(spark, sf_dir, "documents"), "src1", "source")
    return rows.select("doc_id", F.md5("text").alias("preview_md5"))


@query
def classify_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", catalog.classify(F.col("text")).alias("classification"))


@query
def report_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("role", catalog.classify(F.col("text")).alias("classification"))
    return rows.groupBy("classification").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("n_user"))


@query
def report_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(_read(spark, sf_dir, "conversations"), "THER", "text", "role").select("conv_id", "turn")


@query
def newest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("text_md5"))
    return catalog.newest(rows, 100, F.col("conv_id").desc(), F.col("turn").desc(), F.col("text_md5"))


@query
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(_read(spark, sf_dir, "pages").select("page_id", "url"), "1", "url")


@query
def ingest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    short = F.col("n_chars") < 200
    files = docs.select(F.when(short, "error").otherwise("done").alias("status"), F.col("n_chars").alias("chunk_count"), F.when(F.col("lang") != "en", 1).otherwise(0).alias("warnings"))
    return catalog.ingest_rollup(files)


__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

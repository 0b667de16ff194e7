"""Taking documents in, end to end: pages, cleaned text, chunks, vectors, manifest.

What becomes of each file follows from a ledger: one full join of the files,
the manifest and the chunks that are there. Rows, counts and the result come
from it, and `save` writes what changed to a store in one step.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.order import numbered
from scholia.operators import catalog, chunking, clean
from scholia.operators.embedding import Embedder, embed, letter_shares
from scholia.sources.files import SCHEMAS
from scholia.sources.store import Change, Staging, Store

# What an ingest reports.
NO_FILES = "No PDF files found. Place PDFs in attached_assets/ or upload via the UI."
NO_CHUNKS = "No usable chunks extracted from document"
PARSE_FAILED, EMBED_FAILED = "PDF parse error: ", "Embedding failed: "


class Tables(NamedTuple):
    """What was taken in before."""

    manifest: DataFrame
    chunks: DataFrame
    index: DataFrame


class Ingest(NamedTuple):
    """The tables after an ingest; what it read and cleaned; the documents (document_id)
    whose rows are new and those whose vectors are; a row a file; one row over all."""

    tables: Tables
    raw: DataFrame
    cleaned: DataFrame
    taken: DataFrame
    embedded: DataFrame
    files: DataFrame
    result: DataFrame
    staging: Staging


def no_tables(spark: SparkSession) -> Tables:
    return Tables(*[spark.createDataFrame([], SCHEMAS[t]) for t in ("documents", "chunks", "vectors")])


def ledger(files: DataFrame, before: Tables, anew: bool) -> DataFrame:
    """A row a file: document_id, filename, file_path, unreadable, error, state, and of the
    document before pages_before, flags_before, chunks_before.

    state: known (has chunks, and is left as it is), taken, failed (can't be read), repeated
    (another file of that document is taken: the first that can be read by its path, or
    where all is done anew the last, as later files replace earlier ones), and absent: no
    file, only a row of the manifest.
    """
    counts = before.chunks.groupBy("document_id").agg(F.count("*").alias("chunks_before"))
    held = before.manifest.select("document_id", F.col("page_count").alias("pages_before"), F.col("cleaning_flags").alias("flags_before"), F.lit(True).alias("listed")).join(counts, "document_id", "left")
    readable = F.when(~F.col("unreadable"), F.col("file_path"))
    chosen = files.groupBy("document_id").agg((F.max(readable) if anew else F.min(readable)).alias("chosen"))
    known = F.lit(False) if anew else F.col("listed").isNotNull() & (F.coalesce("chunks_before", F.lit(0)) > 0)
    state = F.when(F.col("file_path").isNull(), "absent").when(known, "known").when(F.col("unreadable"), "failed").when(F.col("file_path") == F.col("chosen"), "taken").otherwise("repeated")
    rows = files.join(chosen, "document_id").join(held, "document_id", "full")
    return rows.select("document_id", "filename", "file_path", "unreadable", "error", state.alias("state"), "pages_before", "flags_before", F.coalesce("chunks_before", F.lit(0)).alias("chunks_before"))


def read_and_cleaned(pages: DataFrame) -> DataFrame:
    """Pages (document_id, filename, page_texts) with full_text, its parts' lengths and the cleaned text, flags and notes."""
    whole = F.concat(F.lit("\n\n"), F.array_join("page_texts", "\n\n"))
    docs = pages.withColumns({"text": whole, "page_sizes": F.transform("page_texts", F.length)})
    return clean.clean(docs).withColumnRenamed("text", "full_text")


def chunks_of(docs: DataFrame) -> DataFrame:
    """The chunk rows of cleaned documents."""
    made = chunking.chunk(docs.select("document_id", F.col("cleaned_text").alias("text"), "page_sizes"), "document_id", "text", "page_sizes")
    named = made.join(docs.select("document_id", F.col("filename").alias("source_file"), "cleaning_flags"), "document_id")
    none = F.array().cast("array<string>")
    return named.select("chunk_id", "document_id", "source_file", "page_start", "page_end", "section_path", "text", "cleaning_flags", none.alias("quality_notes"))


def file_report(rows: DataFrame, docs: DataFrame, chunks: DataFrame, prefix: bool = True) -> DataFrame:
    """Of a ledger, the documents taken and their chunks, a row a file: document_id, filename,
    file_path, state, page_count, chunk_count, status, error, cleaning_flags, warnings."""
    none = F.array().cast("array<string>")
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks_made"))
    made = docs.select("document_id", F.size("page_texts").alias("pages_made"), F.col("cleaning_flags").alias("flags_made"), "quality_notes").join(counts, "document_id", "left")
    rows = rows.where("state <> 'absent'").join(made, "document_id", "left")
    taken, failed, known = F.col("state") == "taken", F.col("state") == "failed", F.col("state") == "known"
    chunk_count = F.when(failed, 0).when(known, F.col("chunks_before")).otherwise(F.coalesce("chunks_made", F.lit(0))).cast("int")
    flags = F.when(failed, none).when(known, F.coalesce("flags_before", none)).otherwise(F.coalesce("flags_made", none))
    said = [
        F.when(F.size("flags_made") > 0, F.concat(F.lit("Cleaning applied: "), F.array_join("flags_made", ", "))),
        F.when(F.size("quality_notes") > 0, F.concat(F.lit("Quality: "), F.array_join("quality_notes", ", "))), F.when(F.coalesce("chunks_made", F.lit(0)) == 0, F.lit(NO_CHUNKS)),
    ]
    warned = F.when(taken, F.array_compact(F.array(*said))).otherwise(none)
    warnings = F.transform(warned, lambda w: F.concat("filename", F.lit(": "), w)) if prefix else warned
    return rows.select(
        "document_id", "filename", "file_path", "state", F.when(failed, 0).when(known, F.col("pages_before")).otherwise(F.coalesce("pages_made", F.lit(0))).cast("int").alias("page_count"), chunk_count.alias("chunk_count"),
        F.when(failed, "error").otherwise("ingested").alias("status"), F.when(failed, F.concat(F.lit(PARSE_FAILED), F.coalesce("error", F.lit("unreadable")))).alias("error"), flags.alias("cleaning_flags"), warnings.alias("warnings"),
    )


def ingest_result(files: DataFrame, vectors: DataFrame, upload: bool = False) -> DataFrame:
    """One row: success, documents, chunks, vectors, n_errors, n_warnings, n_files, error (that
    there are no files, or one that embedding failed with). What each file's errors,
    warnings and flags are is in its own row. Failed vectors don't count against
    success, and are one error together."""
    counted = (F.col("status") == "ingested") & (F.lit(upload) | (F.col("chunk_count") > 0))
    one = files.agg(
        F.count("*").alias("n_files"), F.count_if(counted).alias("documents"), F.coalesce(F.sum(F.when(counted, F.col("chunk_count"))), F.lit(0)).alias("chunks"),
        F.count("error").alias("_errors"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("n_warnings"),
    )
    made = vectors.agg(F.count("embedding").alias("vectors"), F.min("embedding_error").alias("_failed"))
    none, failed = F.col("n_files") == 0, F.col("_failed").isNotNull()
    errors = F.col("_errors") + F.when(none, 1).otherwise(0) + F.when(failed, 1).otherwise(0)
    success = ~none & ((F.col("documents") > 0) | (F.lit(not upload) & (F.col("_errors") == 0)))
    said = F.when(none, F.lit(NO_FILES)).when(failed, F.concat(F.lit(EMBED_FAILED), "_failed"))
    return one.crossJoin(made).select(success.alias("success"), "documents", "chunks", "vectors", errors.alias("n_errors"), "n_warnings", "n_files", said.alias("error"))


def ingest(pages: DataFrame, before: Tables, at: Column, embedder: Embedder = letter_shares, rebuild: bool = False, upload: bool = False, **calls) -> Ingest:
    """Take in files by their pages: document_id, filename, page_texts (null: can't be read),
    and if they are known file_path and error.

    Documents with chunks are left as they are; of those that lack vectors the chunks are
    embedded. rebuild: everything from before goes first. upload: the documents of the
    files, and no others, are taken in anew; one that can't be read stays as it was.
    Files that can't be read are in the report, but not in the manifest. New chunks are
    put in the index in the place of their earlier versions or else at its end, in the
    order of files and chunks; a document that is taken in anew leaves no chunk of its
    earlier version. Cleaned texts, chunks and vectors are made once and staged.
    calls: how the embedder is called (see embed).
    """
    if rebuild:
        before = Tables(*[catalog.reset(t) for t in before])
    rows = pages.withColumn("unreadable", F.col("page_texts").isNull())
    rows = rows if "file_path" in pages.columns else rows.withColumn("file_path", F.col("filename"))
    rows = rows if "error" in pages.columns else rows.withColumn("error", F.lit(None).cast("string"))
    staging = Staging(pages.sparkSession)
    listed = staging.put(ledger(rows.select("document_id", "filename", "file_path", "unreadable", "error"), before, rebuild or upload), "ledger")
    taken = listed.where("state = 'taken'").select("document_id", "file_path").distinct()
    # A file that is listed twice is read once.
    docs = rows.join(taken, ["document_id", "file_path"]).dropDuplicates(["document_id"])
    docs = staging.put(read_and_cleaned(docs.select("document_id", "filename", "file_path", "page_texts")), "cleaned")
    made = staging.put(chunks_of(docs), "chunks")
    files = staging.put(file_report(listed, docs, made, prefix=not upload), "files")
    ids = taken.select("document_id")
    chunks = before.chunks.join(ids, "document_id", "left_anti").select(*made.columns).unionByName(made)
    present = files.where("status = 'ingested'").select("document_id").distinct()
    # Vectors of a document that is taken in anew don't count: its texts may have changed.
    valid = before.index.join(ids, "document_id", "left_anti")
    fresh = catalog.only_new(chunks.join(present, "document_id", "left_semi"), valid, "chunk_id")
    vectors = staging.put(embed(fresh.drop("quality_notes"), embedder, **calls), "vectors")
    order = files.groupBy("document_id").agg(F.min("file_path").alias("_path"))
    good = vectors.where("embedding is not null").drop("embedding_error").join(order, "document_id").withColumn("_size", F.length("chunk_id"))
    placed = staging.put(numbered(good, ["_path", "document_id", "_size", "chunk_id"]).drop("_path", "_size"), "placed")
    # What a shorter new version lacks goes; what is embedded anew keeps its place.
    stale = before.index.join(ids, "document_id", "left_semi").select("chunk_id").join(placed.select("chunk_id"), "chunk_id", "left_anti")
    after = catalog.upsert(before.index.join(stale, "chunk_id", "left_anti"), placed.select(*before.index.columns), "chunk_id")
    new_rows = files.where("state = 'taken'").dropDuplicates(["document_id"]).select("document_id", "filename", "file_path", "page_count", "chunk_count", at.alias("ingested_at"), "status", "cleaning_flags")
    manifest = before.manifest.join(ids, "document_id", "left_anti").select(*new_rows.columns).unionByName(new_rows)
    raw = docs.select("document_id", "filename", "page_texts", "full_text")
    cleaned = docs.select("document_id", "filename", "cleaned_text", "cleaning_flags", "quality_notes")
    changed = ids.unionByName(placed.select("document_id")).distinct()
    return Ingest(Tables(manifest, chunks, after), raw, cleaned, ids, changed, files, ingest_result(files, vectors, upload), staging)


def load(store: Store) -> Tables:
    """The tables of a store, empty where there are none yet."""
    return Tables(*[store.read(t, SCHEMAS[t]) for t in ("documents", "chunks", "vectors")])


def save(store: Store, done: Ingest, rebuild: bool = False, applied: tuple[str, int] | None = None) -> int:
    """Write what an ingest changed, all tables in one step; the store's new version. What
    was staged for it is deleted, so its tables are to be read from the store from now on."""
    gone = None if rebuild else done.taken
    of = lambda df, ids: df if rebuild else df.join(ids, "document_id", "left_semi").select(*df.columns)
    version = store.commit(
        Change("raw", done.raw, done.taken), Change("clean", done.cleaned, done.taken), Change("chunks", of(done.tables.chunks, done.taken), gone),
        Change("documents", of(done.tables.manifest, done.taken), gone), Change("vectors", of(done.tables.index, done.embedded), None if rebuild else done.embedded), applied=applied,
    )
    done.staging.clear()
    return version


def reset(store: Store) -> int:
    """Manifest, chunks and vectors go; what was read and cleaned stays."""
    return store.reset("documents", "chunks", "vectors")

"""Manifest, index and report tables: upserts, deletes, roll-ups and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.order import numbered

# What a question is about, the first that matches.
TOPICS = [
    ("flood-hazard", "flood|inundation|surge|hurricane|storm"), ("emergency-management", "evacuation|shelter|emergency|preparedness"),
    ("risk-assessment", "risk|vulnerability|exposure"), ("climate", "climate|sea level|temperature|precipitation"), ("infrastructure", "building|structure|infrastructure"),
]


def document_id(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filename, "[^a-zA-Z0-9_-]", "_"), "_+", "_")


def classify(question: Column) -> Column:
    out = F.when(F.lit(False), "")
    for topic, words in TOPICS:
        out = out.when(F.lower(question).rlike(words), topic)
    return out.otherwise("general")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` take the place (pos) of rows with their key; the others are
    appended in their order. Both have a pos; equal keys within `new` are all kept
    where the key is new."""
    places = old.select(key, F.col("pos").alias("_pos"))
    end = old.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("_end"))
    placed = new.join(places, key, "left").crossJoin(F.broadcast(end))
    placed = placed.withColumn("pos", F.coalesce("_pos", F.col("_end") + F.col("pos"))).select(*old.columns)
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(placed)


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(key).orderBy(F.col(at).desc())
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def only_new(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    return rows.join(index.select(key), key, "left_anti")


def delete_documents(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return index.join(gone.select(key), key, "left_anti")


def replace_document(index: DataFrame, new: DataFrame, document: str, key: str) -> DataFrame:
    """Upsert whole documents: what a shorter new version lacks doesn't stay behind."""
    return upsert(delete_documents(index, new.select(document).distinct(), document), new, key)


def append_report(log: DataFrame, new: DataFrame, at: Column, key: str = "id", k: int = 100) -> DataFrame:
    """The k newest rows of a log with new ones put before it; a new row's id is made of
    the time (a timestamp) and, within one time, its number by question."""
    placed = numbered(new.withColumn("created_at", at), ["created_at", "question"], "_n")
    begun = placed.groupBy(F.col("created_at").alias("_at")).agg(F.min("_n").alias("_first"))
    stamped = placed.join(begun, F.col("created_at").eqNullSafe(F.col("_at")))
    nth = F.col("_n") - F.col("_first")
    made = F.concat(F.lit("report_"), F.unix_millis(F.to_timestamp("created_at")).cast("string"), F.when(nth > 0, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""))
    stamped = stamped.withColumn(key, made).drop("_n", "_at", "_first")
    return newest(stamped.unionByName(log, allowMissingColumns=True), k, F.col("created_at").desc(), F.col(key).desc())


def reset(table: DataFrame) -> DataFrame:
    """The table without its rows, as an index or manifest is before anything is taken in."""
    return table.limit(0)


def document_list(manifest: DataFrame, needle: str | None = None) -> DataFrame:
    """The manifest's rows in the order of their ids, those with the needle in their file name if one is given."""
    rows = manifest if needle is None else search(manifest, needle, "filename")
    return rows.orderBy("document_id")


def confidence_counts(reports: DataFrame, level: str = "candidate_confidence") -> DataFrame:
    """One row: total, high, medium, low, insufficient."""
    return reports.agg(F.count("*").alias("total"), *[F.count_if(F.col(level) == n).alias(n) for n in ("high", "medium", "low", "insufficient")])


def newest(reports: DataFrame, k: int = 100, *order: Column) -> DataFrame:
    return reports.orderBy(*order).limit(k)


# What a status notes.
SOURCE_FILES, UPLOADED_FILES, NOT_INGESTED = " source PDFs available in attached_assets/", " uploaded PDFs", 'Documents available but not yet ingested. Click "Ingest Documents" to start.'


def status(manifest: DataFrame, index: DataFrame, sources: DataFrame | None = None, uploads: DataFrame | None = None) -> DataFrame:
    """One row: documents, chunks, vectors, last_ingested_at, ready; with tables of files,
    notes too: how many there are of either kind, and whether none is taken in yet."""
    one = manifest.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.max("ingested_at").alias("last_ingested_at"))
    row = one.crossJoin(index.agg(F.count("*").alias("vectors"))).withColumn("ready", F.col("vectors") > 0)
    if sources is None and uploads is None:
        return row
    count = lambda df, name: df.agg(F.count("*").alias(name)) if df is not None else index.sparkSession.range(1).select(F.lit(0).cast("long").alias(name))
    row = row.crossJoin(count(sources, "_sources")).crossJoin(count(uploads, "_uploads"))
    counted = lambda name, said: F.when(F.col(name) > 0, F.concat(F.col(name).cast("string"), F.lit(said)))
    waiting = F.when(~F.col("ready") & (F.col("_sources") + F.col("_uploads") > 0), NOT_INGESTED)
    notes = F.array_compact(F.array(counted("_sources", SOURCE_FILES), counted("_uploads", UPLOADED_FILES), waiting))
    return row.withColumn("notes", notes).drop("_sources", "_uploads")


def preview(chunks: DataFrame, document: str | None = None, key: str = "document_id", most: int = 500) -> DataFrame:
    text = F.concat(F.left("text", F.lit(most)), F.when(F.length("text") > most, "…").otherwise(""))
    rows = chunks if document is None else chunks.where(F.col(key) == document)
    return rows.withColumn("text", text)


def search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the needle in any of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(c), F.lit(needle.lower()))
    return rows.where(hit)


def ingest_rollup(files: DataFrame) -> DataFrame:
    """One row over files (status, chunk_count, warnings): documents, chunks, errors,
    warnings, success."""
    one = files.agg(F.count_if(F.col("status") != "error").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.count_if(F.col("status") == "error").alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))
    return one.withColumn("success", (F.col("errors") == 0) | (F.col("documents") > 0))

"""Files: PDFs as bytes, page texts, chunks as JSON lines, tables as Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators.catalog import document_id

MOST_BYTES = 50 << 20
SCHEMAS = {
    "documents": "document_id string, filename string, file_path string, page_count int, chunk_count int, ingested_at timestamp, status string, cleaning_flags array<string>",
    "raw": "document_id string, filename string, page_texts array<string>, full_text string",
    "clean": "document_id string, filename string, cleaned_text string, cleaning_flags array<string>, quality_notes array<string>",
    "chunks": "chunk_id string, document_id string, source_file string, page_start int, page_end int, section_path string, text string, cleaning_flags array<string>, quality_notes array<string>",
    "vectors": "chunk_id string, document_id string, source_file string, page_start int, page_end int, section_path string, text string, cleaning_flags array<string>, embedding array<double>, pos long",
    "reports": "id string, question string, candidate_answer string, candidate_confidence string, evidence_quality string, classification string, notes string, created_at timestamp",
}


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of the .pdf files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)


def upload_gate(path: Column, length: Column, kind: Column | None = None) -> Column:
    """Whether a file may be taken in: a PDF by its name or kind, of 50 MB at most."""
    named = path.endswith(".pdf")
    return (named if kind is None else named | (kind == "application/pdf")) & (length <= MOST_BYTES)


def read_pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """Page texts of binary files by `extract`, which gets a file's bytes in a task:
    document_id, filename, file_path, page_texts, error, full_text. A file that can't
    be read has null page texts, and error says why."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pages, errors = [], []
            for content in f.content:
                try:
                    pages.append(extract(content))
                    errors.append(None)
                except Exception as e:  # any file may be damaged
                    pages.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"file_path": f.path, "page_texts": pages, "error": errors})

    rows = files.select("path", "content").mapInPandas(run, "file_path string, page_texts array<string>, error string")
    filename = F.element_at(F.split("file_path", "/"), -1)
    return rows.select(document_id(filename).alias("document_id"), filename.alias("filename"), "file_path", "page_texts", "error", F.concat(F.lit("\n\n"), F.array_join("page_texts", "\n\n")).alias("full_text"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; blank lines don't count, a broken one stops the read."""
    return spark.read.schema(SCHEMAS["chunks"]).option("mode", "FAILFAST").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)

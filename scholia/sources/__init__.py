"""Readers and writers of the tables that the operators work on."""

from .files import SCHEMAS, pdf_files, read_chunks, read_pages, upload_gate, write_chunks, write_table
from .store import Change, Conflict, Staging, Store, shared_dir

__all__ = ["SCHEMAS", "Change", "Conflict", "Staging", "Store", "pdf_files", "read_chunks", "read_pages", "shared_dir", "upload_gate", "write_chunks", "write_table"]

"""Ingest as a stream."""

from .ingest import ingest_stream, take_in

__all__ = ["ingest_stream", "take_in"]

"""Incremental ingest with Structured Streaming."""

from .ingest import api_section_stream, start_section_ingest  # noqa: F401

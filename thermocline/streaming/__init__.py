"""Incremental ingest of cube files that keep arriving (Structured Streaming)."""

from thermocline.streaming.ingest import ingest_cube_files  # noqa: F401

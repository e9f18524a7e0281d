"""Append-only ledgers as streams: states by key, idempotent ingest and windowed counts."""

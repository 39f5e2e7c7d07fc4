"""Streaming forms of ingest and admission; each agrees with its batch form on the same rows."""

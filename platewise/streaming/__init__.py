"""Streaming: the same ingestion as files arrive."""

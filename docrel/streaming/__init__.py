"""Incremental loads by key watermark and by Structured Streaming."""

"""Incremental forms of the page and link jobs on Structured Streaming."""

"""Crawling and incremental arrival."""

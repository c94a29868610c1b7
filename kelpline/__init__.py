"""Spark jobs that build, query and measure a text knowledge base at scale."""

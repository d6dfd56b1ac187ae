"""Versioned-document analytics on Spark: sources, revision algebra, link graphs, page views and retrieval structures."""

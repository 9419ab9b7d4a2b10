"""Spark jobs for genomic breeding data."""

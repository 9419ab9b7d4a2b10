"""Scalar functions: parsing of cells, tail probabilities."""

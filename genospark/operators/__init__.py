"""Operators on genotype calls and phenotypes."""

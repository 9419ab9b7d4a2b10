"""Whole jobs from files to files."""

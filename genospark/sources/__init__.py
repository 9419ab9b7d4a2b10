"""Readers of genotypes, phenotypes and covariates, and writers of results."""

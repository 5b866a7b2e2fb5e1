"""Datasets, running totals and lineage shared by the operators."""

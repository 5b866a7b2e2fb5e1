"""Incremental versions of additive statistics over streams."""

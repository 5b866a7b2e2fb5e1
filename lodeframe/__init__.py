"""Spark analytics for spatial resource tables: block models, point samples and drillholes."""

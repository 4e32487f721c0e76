"""Corvane: composite-index analytics expressed as Spark DataFrame plans."""

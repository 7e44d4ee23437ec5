"""Assay curation, model validation and screening reports as Spark DataFrame operators."""

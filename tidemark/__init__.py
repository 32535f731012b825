"""Tidemark: archive search, reports and record processing as Spark plans."""

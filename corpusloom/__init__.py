"""Data preparation, planning and audit of text corpora on Spark."""

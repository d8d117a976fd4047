"""Spark-first curation, validation and scoring of conversational and tool-calling corpora."""

"""Spark-first analytics over large annotated text corpora."""

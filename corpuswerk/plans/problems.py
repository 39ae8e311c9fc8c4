"""Queries of the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswerk.operators import nested, rowcheck
from corpuswerk.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.places(nested.labelled_nodes(table(spark, sf_dir, "doc_nested"), labels_only=True))


def _table(level: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = nested.node_tables(table(spark, sf_dir, "doc_nested"))[level]
        return own.withColumn("rest", F.to_json("rest"))

    return run


def p1_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.rejected(table(spark, sf_dir, "doc_nested"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowcheck.check_rows(table(spark, sf_dir, "vertical_lines")).failing


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowcheck.check_rows(table(spark, sf_dir, "vertical_lines")).valid


TABLES = {"p1_articles": "doc", "p1_fields": "field", "p1_paragraphs": "p", "p1_sentences": "s", "p1_tokens": "tok", "p1_candidates": "cand"}
QUERIES = {"p1_found": p1_found} | {name: _table(level) for name, level in TABLES.items()} | {f.__name__: f for f in (p1_rejected, p6_found, p6_rows)}

"""Queries of the problems tagged llm, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswerk.llm import boilerplate, cooccurrence, encoding, linking, lookalike, mixing, persons, termstats
from corpuswerk.llm.sql import ORACLES as ORACLES
from corpuswerk.operators.annotated import mentions, unique_tokens
from corpuswerk.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link(table(spark, sf_dir, "df_fields"), table(spark, sf_dir, "gazetteer"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = termstats.load_in_two_steps(table(spark, sf_dir, "df_fields"))
    return store.marked().filter("mark is not null").select("term", "mark")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termstats.load_in_two_steps(table(spark, sf_dir, "df_fields")).marked()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = table(spark, sf_dir, "doc").select(F.col("autor").alias("spelling"))
    named = mentions(table(spark, sf_dir, "df_fields")).filter("kind = 'PER'").select("spelling")
    return persons.same_names(authors.unionByName(named))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.find_boilerplate(table(spark, sf_dir, "df_fields")).found.select("sid")


def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boilerplate.find_boilerplate(table(spark, sf_dir, "df_fields")).found
    return found.select("docsrc", F.hex("block").alias("block"), "line", "support").distinct()


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "df_fields")
    return boilerplate.without_boilerplate(rows, boilerplate.find_boilerplate(rows))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A delivery that names nothing is as good as an empty one: so only names are shuffled with their terms.
    item = F.when(F.col("ner").isNotNull() & (F.col("iob") == "B"), termstats.base())
    named = unique_tokens(table(spark, sf_dir, "df_fields").withColumn("item", item), "item").filter("item is not null")
    return named.select("sid", F.explode(termstats.terms_of("item")).alias("term"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.pair_counts(_baskets(spark, sf_dir), "sid", "term", min_count=5)
    return cooccurrence.above_chance(pairs, 4).select("term_a", "term_b")


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.pair_counts(_baskets(spark, sf_dir), "sid", "term")
    return pairs.withColumns({"lift": F.round("lift", 6), "pmi": F.round("pmi", 6)})


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.decode(encoding.encode(table(spark, sf_dir, "documents")))


def _mix(spark: SparkSession, sf_dir: str, of_all: float | None = None) -> mixing.Mix:
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    wanted = docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    return mixing.mix(encoding.count_tokens(wanted, keep=("source",)), targets, of_all=of_all)


def p9_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).sample


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares


def p9_capped_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares and shortfalls where half of all tokens are asked for, whatever the smallest source allows."""
    return _mix(spark, sf_dir, 0.5).shares


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_alikes(table(spark, sf_dir, "documents"))


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "form")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.form_classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_counts, p4_found, p5_found, p5_blocks, p5_clean, p7_found, p7_pairs, p8_ids, p8_decoded, p9_sample, p9_shares, p9_capped_shares, p10_found, p10_forms, p10_classes)}

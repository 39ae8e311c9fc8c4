"""Counts over documents and their metadata.

Defined cases: a document without a property counts under the empty string; a size that is no
number counts as a document but adds nothing; keys are true columns, so that values with
underscores stay whole; empty tables give no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_headers(headers: DataFrame, key: str = "id") -> DataFrame:
    """The latest delivery of each header; headers without a key are left out."""
    values = [c for c in headers.columns if c not in (key, "load_ts")]
    one = headers.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("load_ts", *values)).alias("v"))
    return one.select(key, "v.*")


def as_meta(headers: DataFrame, *columns: str) -> DataFrame:
    """headers with a map `meta` of those of the columns that are not null."""
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns]), lambda p: p["value"].isNotNull())
    return headers.withColumn("meta", F.map_from_entries(pairs))


def _props(docs: DataFrame, props: tuple[str, ...], transform: dict[str, Column] | None) -> DataFrame:
    out = docs.select("meta", *[F.coalesce(F.try_element_at("meta", F.lit(p)), F.lit("")).alias(p) for p in props])
    for name, values in (transform or {}).items():  # a list of values fans out
        out = out.withColumn(name, F.explode(values))
    return out


def _size(size: str) -> Column:
    value = F.trim(F.try_element_at("meta", F.lit(size)))
    return F.when(value.rlike(r"\A[+-]?[0-9]+\z"), value.try_cast("bigint"))


def count_by_meta(docs: DataFrame, *props: str, transform: dict[str, Column] | None = None) -> DataFrame:
    """(props, n_docs)."""
    return _props(docs, props, transform).groupBy(*props, *(transform or {})).agg(F.count("*").alias("n_docs"))


def sum_by_meta(docs: DataFrame, *props: str, size: str = "tokens", transform: dict[str, Column] | None = None) -> DataFrame:
    """(props, n_tokens)."""
    return _props(docs, props, transform).groupBy(*props, *(transform or {})).agg(F.coalesce(F.sum(_size(size)), F.lit(0)).alias("n_tokens"))


def mean_by_meta(docs: DataFrame, *props: str, size: str = "tokens", transform: dict[str, Column] | None = None) -> DataFrame:
    """(props, n_docs, n_tokens, mean_tokens) in one pass."""
    out = _props(docs, props, transform).groupBy(*props, *(transform or {})).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(_size(size)), F.lit(0)).alias("n_tokens"))
    return out.withColumn("mean_tokens", F.col("n_tokens") / F.col("n_docs"))


def count_meta_keys(docs: DataFrame) -> DataFrame:
    """(key, n_docs)."""
    return docs.select(F.explode(F.map_keys("meta")).alias("key")).groupBy("key").agg(F.count("*").alias("n_docs"))


def text_counters(tokens: DataFrame, *keys: str, word: str = "word", sentence: str = "sid") -> DataFrame:
    """(keys, n_words, n_chars, n_long, n_sents): words, their characters, those of seven and more, and sentences."""
    length = F.length(word)
    return tokens.groupBy(*keys).agg(
        F.count(word).alias("n_words"), F.coalesce(F.sum(length), F.lit(0)).cast("bigint").alias("n_chars"), F.count(F.when(length >= 7, 1)).alias("n_long"), F.count_distinct(sentence).alias("n_sents")
    )


def inventory_counts(files: DataFrame, key: str, size: str = "size") -> DataFrame:
    """(key, n_files, bytes) of the files whose key is known."""
    return files.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_files"), F.sum(size).alias("bytes"))

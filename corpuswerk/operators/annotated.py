"""Tokens and mentions of annotated token rows.

Defined cases, shared by all that build on this module:
rows without sid or ix are no tokens; deliveries of one (sid, ix) count once, the one with the
greatest load_ts wins and equal load_ts are settled by the greatest values; empty input gives empty
output; columns not asked for are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\u000b "


def unique_tokens(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per (sid, ix) with the asked columns of its latest delivery, partitioned by sid."""
    rows = rows.filter(F.col("sid").isNotNull() & F.col("ix").isNotNull())
    values = [c for c in columns if c != "load_ts"]
    latest = F.max(F.struct("load_ts", *values))
    one = rows.select("sid", "ix", "load_ts", *values).repartition("sid").groupBy("sid", "ix").agg(latest.alias("v"))
    return one.select("sid", "ix", *[F.col(f"v.{c}").alias(c) for c in columns])


def mentions(tokens: DataFrame) -> DataFrame:
    """Runs of named tokens: (sid, ix of the first token, kind, spelling).

    A run opens at iob B, or at I where the token before is not of an open run; other iob values
    and rows without ner belong to no run.
    """
    # A delivery that is of no run is as good as an empty one: so only words of names are shuffled.
    part = F.when(F.col("ner").isNotNull() & F.col("iob").isin("B", "I"), F.struct("ner", "iob", "word"))
    named = unique_tokens(tokens.withColumn("part", part), "part").filter("part is not null").select("sid", "ix", "part.*")
    order = Window.partitionBy("sid").orderBy("ix")
    opens = (F.col("iob") == "B") | F.lag("ix").over(order).isNull() | (F.lag("ix").over(order) != F.col("ix") - 1)
    runs = named.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(order))
    grouped = runs.groupBy("sid", "run").agg(
        F.min("ix").alias("ix"),
        F.min(F.struct("ix", "ner")).alias("first"),
        F.sort_array(F.collect_list(F.struct("ix", F.coalesce("word", F.lit("")).alias("word")))).alias("parts"),
    )
    return grouped.select("sid", "ix", F.col("first.ner").alias("kind"), F.array_join("parts.word", " ").alias("spelling"))


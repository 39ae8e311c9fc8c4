"""Views of the test tables that the queries of the annotated corpus share.

The lexicon is a small invented one over frequent lemmas; any table (word, kind, value) takes its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswerk.operators import gazetteer, wordclass
from corpuswerk.operators.annotated import unique_tokens
from corpuswerk.operators.stats import latest_headers
from corpuswerk.plans.storage import materialized
from corpuswerk.sinks import graph_tables
from corpuswerk.sources.tables import table

POLARITY = [
    ("loben", "POS", 0.4), ("gewinnen", "POS", 0.3), ("retten", "POS", 0.5), ("begrüßen", "POS", 0.3), ("unterstützen", "POS", 0.2), ("günstig", "POS", 0.2), ("beliebt", "POS", 0.4), ("stark", "POS", 0.1), ("modern", "POS", 0.2), ("kritisch", "POS", 0.1),
    ("verlieren", "NEG", -0.3), ("kritisieren", "NEG", -0.4), ("verhindern", "NEG", -0.2), ("kürzen", "NEG", -0.2), ("bremsen", "NEG", -0.2), ("schwierig", "NEG", -0.3), ("schwach", "NEG", -0.2), ("teuer", "NEG", -0.3), ("umstritten", "NEG", -0.2), ("kritisch", "NEG", -0.5),
]
EMOTIONS = [("gewinnen", "FREUDE"), ("loben", "FREUDE"), ("beliebt", "FREUDE"), ("schwierig", "FURCHT"), ("verlieren", "FURCHT"), ("unbekannt", "FURCHT"), ("verlieren", "TRAUER"), ("schwach", "TRAUER"), ("kritisieren", "WUT"), ("umstritten", "WUT")]
STOP = ["die", "der", "und", "bereits", "erneut", "neu", "lohnpreis", "zeigen"]
TOKEN_COLUMNS = ["id_article", "docsrc", "wert", "word", "lemma", "pos", "posTT", "posUDS", "posTI", "dep", "ner", "iob", "ixNP", "ixDEP"]


def tokens(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return unique_tokens(table(spark, sf_dir, "df_fields"), *(columns or TOKEN_COLUMNS))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordclass.classified(tokens(spark, sf_dir))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_headers(table(spark, sf_dir, "doc"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, date_int, docsrc, section)."""
    date = F.replace("datum", F.lit("-"), F.lit("")).try_cast("int")
    return headers(spark, sf_dir).select(F.col("id_article").alias("doc_id"), date.alias("date_int"), "docsrc", "ressort2").withColumnRenamed("ressort2", "section")


def polarity(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLARITY, "word string, kind string, value double")


def emotions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EMOTIONS, "word string, kind string")


def stop(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP], "word string")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gazetteer.gazetteer_names(table(spark, sf_dir, "gazetteer"))


def word_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_tables.word_mentions(classified(spark, sf_dir), stop(spark))


def mentions(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Mentions of words, entities, polarity and emotions, or of the parts asked for."""
    parts = parts or ("words", "entities", "polarity", "emotions")
    out = None
    if any(p != "entities" for p in parts):
        words = word_mentions(spark, sf_dir)
        words = materialized(words, "word_mentions") if len(parts) > 1 else words
    for part in parts:
        if part == "words":
            own = words.filter("etype is not null")
        elif part == "polarity":
            own = graph_tables.polarity_mentions(words, polarity(spark))
        elif part == "emotions":
            own = graph_tables.emotion_mentions(words, emotions(spark))
        else:
            t = tokens(spark, sf_dir, "id_article", "word", "ner", "iob")
            own = graph_tables.entity_mentions(wordclass.entity_spans(t), t.groupBy("sid").agg(F.min("id_article").alias("id_article")), names(spark, sf_dir), stop(spark))
        own = own.withColumnRenamed("id_article", "doc_id")
        own = own.select("sid", "doc_id", "ix", "word", "etype", "is_stop", *[F.col(c) if c in own.columns else F.lit(None).cast(t).alias(c) for c, t in (("wid", "string"), ("valence", "double"))])
        out = own if out is None else out.unionByName(own)
    return out


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, name, firstnames, lastnames, views): authors written often enough, with the number of their articles for views."""
    often = headers(spark, sf_dir).filter(F.col("autor").rlike(r"^\p{L}+ \p{Lu}[\p{L}-]+$") & ~F.col("autor").rlike("^(Red|RED|red)")).groupBy("autor").agg(F.count("*").alias("views")).filter("views >= 3")
    words = F.split("autor", " ")
    return often.select(F.concat(F.lit("P:"), "autor").alias("pid"), F.col("autor").alias("name"), F.array(words[0]).alias("firstnames"), F.array(words[1]).alias("lastnames"), "views")

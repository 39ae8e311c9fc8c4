"""Whole articles: their parts taken out of the running text, and their paragraphs out of marked-up files.

Files are rows (path, text) with <doc ...> elements that hold <p> elements. Defined cases: a part that
isn't there is null; a document without paragraphs has an empty text and no paragraph row; repeated
attributes count by their last value; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswerk.functions import text as fn


def parsed(articles: DataFrame, text: str = "text", tokens_only: bool = False) -> DataFrame:
    """Adds place, agency, subtitle, body, note and tokens of a running text.

    The parts are cut out before special characters go; with tokens_only these go first, so that no part
    is found and everything stays among the tokens.
    """
    clean = F.trim(fn.collapse_blanks(fn.attach_punctuation(text)))
    if tokens_only:
        return articles.withColumn("tokens", fn.wordpunct_tokens(fn.only_words(clean)))
    out = articles.withColumn("part_s", fn.subtitle(clean)).withColumn("part_d", fn.dateline("part_s.rest")).withColumn("part_n", fn.final_note("part_d.rest"))
    out = out.withColumns({"subtitle": F.col("part_s.subtitle"), "place": F.col("part_d.place"), "agency": F.col("part_d.agency"), "note": F.col("part_n.note"), "body": F.trim("part_n.rest")})
    return out.withColumn("tokens", fn.wordpunct_tokens(fn.only_words("body"))).drop("part_s", "part_d", "part_n")


def documents(files: DataFrame, people: list[tuple[str, str, str, str]] = ()) -> DataFrame:
    """(path, doc_ix, meta, content) of each document; the names of people become their surnames in the content, not in the attributes."""
    docs = files.select("path", F.posexplode(fn.documents_of("text")).alias("doc_ix", "d"))
    return docs.select("path", "doc_ix", "d.meta", fn.normalise_names(F.col("d.content"), list(people)).alias("content"))


def document_texts(docs: DataFrame) -> DataFrame:
    """(meta, text): the paragraphs in lower case, joined by blanks."""
    return docs.select("meta", F.array_join(fn.paragraphs_of(F.lower("content")), " ").alias("text"))


def paragraph_rows(docs: DataFrame, lower: bool = True) -> DataFrame:
    """(meta, p_ix, paragraph)."""
    content = F.lower("content") if lower else F.col("content")
    return docs.select("meta", F.posexplode(fn.paragraphs_of(content)).alias("p_ix", "paragraph"))


def having_any(docs: DataFrame, values: list[str]) -> DataFrame:
    """Documents with one of the values among the names or values of their attributes."""
    listed = F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    return docs.filter(F.arrays_overlap(F.concat(F.map_keys("meta"), F.map_values("meta")), listed))


def paragraphs_with(docs: DataFrame, keys: list[str], more_than: int = 3) -> DataFrame:
    """(keys, p_ix, paragraph) of paragraphs of more than so many words, as they stand."""
    rows = paragraph_rows(docs, lower=False)
    words = F.filter(F.split("paragraph", r"\s+"), lambda w: w != "")
    return rows.filter(F.size(words) > more_than).select(*[F.try_element_at("meta", F.lit(k)).alias(k) for k in keys], "p_ix", "paragraph")


def attribute_rows(docs: DataFrame) -> DataFrame:
    """(path, doc_ix, key, value) of every attribute."""
    return docs.select("path", "doc_ix", F.explode("meta").alias("key", "value"))


def words_of(tokens: DataFrame, unit: list[str], kept: Column) -> DataFrame:
    """(unit, words): the kept words of each unit, in order."""
    words = F.sort_array(F.collect_list(F.struct("sid", "ix", F.coalesce("word", F.lit("")).alias("word"))))
    return tokens.filter(kept).groupBy(*unit).agg(words["word"].alias("words"))

"""Lines repeated across the documents of one source, and the documents without them.

Nodes of a weighted graph are the lines of a source, weighted by the number of its articles that
hold them; edges join lines that follow each other in an article, weighted alike. Nodes and edges
of high support stay, connected components are the boilerplate blocks, and the occurrences of the
lines of a block are deleted. least_lines is how many lines make a block: with 1, as problem 5 has it,
a line that stands alone is one; with more, only lines that edges tie to others go, and of an
article only what holds so many neighbouring lines of the block. Lines only serve to find them: what
stays of an article are its sentences of all parts (wert) with the words as they stand.

Defined cases: as in operators.annotated for missing keys and repeated deliveries, the part (wert)
being that of the latest delivery; sentences of no article count for no support and stand in no
article; a null source is a source of its own; a sentence without letters
has an empty line, is never boilerplate and stays; a line repeated within one article counts once;
a word without letters is left out of the line; very long lines are known by their digest; empty
tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuswerk.operators.annotated import unique_tokens
from corpuswerk.operators.graph import connected_components
from corpuswerk.plans.storage import materialized


@dataclass(frozen=True)
class Boilerplate:
    blocks: DataFrame
    found: DataFrame
    lines: DataFrame


def sentence_lines(rows: DataFrame) -> DataFrame:
    """(sid, id_article, docsrc, line, node) of each sentence of the running text."""
    tokens = unique_tokens(rows, "id_article", "docsrc", "wert", "word").filter("wert = 'inhalt'")
    word = F.regexp_replace(F.lower("word"), r"[^\p{L}]+", "")
    words = F.sort_array(F.collect_list(F.struct("ix", F.coalesce(word, F.lit("")).alias("w"))))
    lines = tokens.groupBy("sid").agg(F.min("id_article").alias("id_article"), F.min("docsrc").alias("docsrc"), words.alias("words"))
    text = F.array_join(F.filter(F.col("words.w"), lambda w: w != ""), " ")
    lines = lines.select("sid", "id_article", "docsrc", text.alias("line"))
    # A line of a source is known by 128 bits of it from here on.
    node = F.when(F.col("line") != "", F.unhex(F.md5(F.concat_ws("\u0000", F.coalesce("docsrc", F.lit("")), "line"))))
    return lines.withColumn("node", node)


def _supported(pairs: DataFrame, keys: list[str], least: int) -> DataFrame:
    return pairs.filter("id_article is not null").select(*keys, "id_article").distinct().groupBy(*keys).agg(F.count("*").alias("support")).filter(F.col("support") >= least)


def find_boilerplate(rows: DataFrame, least_articles: int = 4, least_lines: int = 1) -> Boilerplate:
    lines = materialized(sentence_lines(rows), "lines")
    nodes = materialized(_supported(lines.filter("node is not null"), ["node"], least_articles), "nodes")
    before = F.lag("node").over(Window.partitionBy("id_article").orderBy("sid"))
    steps = lines.filter("id_article is not null").select("id_article", "sid", "node").withColumn("before", before).filter("node is not null and before is not null and node <> before")
    high = nodes.select("node")
    steps = steps.join(high, "node", "left_semi").join(high.select(F.col("node").alias("before")), "before", "left_semi")
    edges = _supported(steps, ["before", "node"], least_articles)
    blocks = connected_components(high, edges.select(F.col("before").alias("src"), F.col("node").alias("dst")), "node")
    blocks = blocks.select("node", F.col("component").alias("block")).join(nodes, "node")
    if least_lines > 1:
        sizes = blocks.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") >= least_lines).select("block")
        blocks = blocks.join(sizes, "block", "left_semi").select("node", "block", "support")
    found = lines.filter("node is not null").join(blocks, "node").select("sid", "id_article", "docsrc", "line", "block", "support")
    if least_lines > 1:
        found = _occurrences(lines, found, least_lines)
    return Boilerplate(blocks, found, lines)


def _occurrences(lines: DataFrame, found: DataFrame, least_lines: int) -> DataFrame:
    """Of found only the sentences in a run of so many neighbouring ones of one block in their article."""
    place = F.row_number().over(Window.partitionBy("id_article").orderBy("sid"))
    placed = lines.filter("node is not null").select("id_article", "sid", place.alias("place"))
    runs = found.join(placed, ["id_article", "sid"]).withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy("id_article", "block").orderBy("sid")))
    n = F.count("*").over(Window.partitionBy("id_article", "block", "run"))
    return runs.withColumn("n", n).filter(F.col("n") >= least_lines).select("sid", "id_article", "docsrc", "line", "block", "support")


def whole_sentences(rows: DataFrame) -> DataFrame:
    """(sid, id_article, text) of each sentence of every part, its words as they stand."""
    tokens = unique_tokens(rows, "id_article", "word")
    words = F.sort_array(F.collect_list(F.struct("ix", "word")))
    return tokens.groupBy("sid").agg(F.min("id_article").alias("id_article"), F.array_join(words["word"], " ").alias("text"))


def without_boilerplate(rows: DataFrame, result: Boilerplate) -> DataFrame:
    """(id_article, n_kept, n_removed, text) of each article, its remaining sentences in order, one a line."""
    marks = result.found.select("sid", F.lit(True).alias("gone"))
    each = whole_sentences(rows).filter("id_article is not null").join(marks, "sid", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    kept = F.sort_array(F.collect_list(F.when(~F.col("gone"), F.struct("sid", "text"))))
    out = each.groupBy("id_article").agg(F.sum((~F.col("gone")).cast("bigint")).alias("n_kept"), F.sum(F.col("gone").cast("bigint")).alias("n_removed"), kept.alias("kept"))
    return out.select("id_article", "n_kept", "n_removed", F.array_join("kept.text", "\n").alias("text"))

"""Reader of vertical files: headers, fields, sentences and typed token rows.

A file is one row of text; documents, fields, sentences and lines are cut out of it row by row with
built-in functions, so that reading shuffles nothing and runs no Python. Defined cases: a missing
attribute is null; a line that begins with `<` and a TAB is a token; blank lines and markup are no
tokens; `<g/>` takes the blank after the token before it; numbers that are none become null; rows of
another number of columns are kept apart with their number (`malformed`); files without documents
give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswerk.functions.text import attributes
from corpuswerk.operators.rowcheck import COLUMNS

# Attributes of a header, in their order.
HEADER = ["id", "datum_full", "datum", "year", "yymm", "bibl", "mediatype", "docsrc", "docsrc_name", "region", "province", "ressort2", "autor", "mutation", "deskriptor", "keys", "tokens", "wordcount", "dupl"]
# Columns of an enriched token row, in their order.
ENRICHED = ["word", "rf_pos", "tt_pos", "lemma", "i", "spacy_pos", "spacy_tag", "spacy_ent_type", "spacy_ent_iob", "ent_id", "ent_type", "ent_iob", "noun_chunk", "dep", "head"]
TYPES = {"ix": "int", "ixDEP": "int", "ixNP": "double", "i": "int", "head": "int"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all files below a folder."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def joined_lines(lines: DataFrame) -> DataFrame:
    """(path, text) of (file_name, line_id, raw_line): one file, of bounded size, a row."""
    parts = F.sort_array(F.collect_list(F.struct("line_id", "raw_line")))
    return lines.groupBy(F.col("file_name").alias("path")).agg(F.array_join(parts["raw_line"], "\n").alias("text"))


def documents(files: DataFrame) -> DataFrame:
    """(path, doc_ix, meta, content) of each <doc>, with its header as a map."""
    whole = F.regexp_extract_all("text", F.lit(r"(?s)<doc [^>]*>.*?</doc>"), F.lit(0))
    docs = files.select("path", F.posexplode(whole).alias("doc_ix", "doc"))
    return docs.select("path", "doc_ix", attributes(F.regexp_extract("doc", r"(?s)^<doc ([^>]*)>", 1)).alias("meta"), F.regexp_extract("doc", r"(?s)^<doc [^>]*>(.*)</doc>$", 1).alias("content"))


def headers(docs: DataFrame) -> DataFrame:
    """The known attributes as columns; missing ones are null. id_article is the place in the file."""
    return docs.select("path", F.col("doc_ix").alias("id_article"), *[F.try_element_at("meta", F.lit(k)).alias(k) for k in HEADER])


def sentences(docs: DataFrame) -> DataFrame:
    """(path, doc_ix, doc_id, field, s_ix, sid, body): sid is unique over all files."""
    doc_id = F.coalesce(F.try_element_at("meta", F.lit("id")), F.concat("path", F.lit("#"), "doc_ix")).alias("doc_id")
    fields = docs.select("path", "doc_ix", doc_id, F.posexplode(F.regexp_extract_all("content", F.lit(r'(?s)<field name="[^"]*">.*?</field>'), F.lit(0))).alias("f_ix", "part"))
    fields = fields.withColumn("field", F.regexp_extract("part", r'^<field name="([^"]*)">', 1))
    each = fields.select("path", "doc_ix", "doc_id", "field", "f_ix", F.posexplode(F.regexp_extract_all("part", F.lit(r"(?s)<s>(.*?)</s>"), F.lit(1))).alias("s_ix", "body"))
    return each.withColumn("sid", F.concat_ws(".", "doc_id", F.concat("field", "f_ix"), "s_ix")).drop("f_ix")


def _token_lines(sents: DataFrame) -> DataFrame:
    lines = F.filter(F.split("body", r"\n"), lambda x: F.trim(x) != "")
    lines = F.transform(lines, lambda x: F.struct(x.alias("line"), (F.startswith(x, F.lit("<")) & ~F.startswith(x, F.lit("<\t"))).alias("markup")))
    each = sents.withColumn("lines", lines)
    next_is_glue = lambda i: F.coalesce(F.get("lines", i + 1)["line"] == "<g/>", F.lit(False))
    kept = F.filter(F.transform("lines", lambda x, i: F.struct(x["line"].alias("line"), x["markup"].alias("markup"), (~next_is_glue(i)).alias("space_after"))), lambda x: ~x["markup"])
    return each.select("path", "doc_ix", "doc_id", "field", "s_ix", "sid", F.posexplode(kept).alias("w_ix", "t")).select("*", F.split("t.line", "\t").alias("cells"), F.col("t.space_after").alias("space_after")).drop("t")


def _typed(cells: Column, at: int, name: str) -> Column:
    value = F.get(cells, F.lit(at))
    return (value.try_cast(TYPES[name]) if name in TYPES else value).alias(name)


def tokens(docs: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """Typed token rows of the right number of columns, with their place."""
    lines = _token_lines(sentences(docs)).filter(F.size("cells") == len(columns))
    return lines.select("path", "doc_ix", "doc_id", "field", "s_ix", "sid", "w_ix", "space_after", *[_typed(F.col("cells"), k, c) for k, c in enumerate(columns)])


def enriched_tokens(docs: DataFrame) -> DataFrame:
    """Rows of the enriched layout; where ent_type is 0 the column of ent_iob is missing and the later ones stand one place before."""
    lines = _token_lines(sentences(docs)).filter(F.size("cells").isin(len(ENRICHED) - 1, len(ENRICHED)))
    cells = F.col("cells")
    full = F.when(F.get(cells, F.lit(10)) == "0", F.concat(F.slice(cells, 1, 11), F.array(F.lit("")), F.slice(cells, 12, 3))).otherwise(cells)
    lines = lines.withColumn("cells", full).filter(F.size("cells") == len(ENRICHED))
    return lines.select("path", "doc_ix", "doc_id", "field", "s_ix", "sid", "w_ix", "space_after", *[_typed(F.col("cells"), k, c) for k, c in enumerate(ENRICHED)])


def malformed(docs: DataFrame, n_columns: int = len(COLUMNS)) -> DataFrame:
    """(doc_id, sid, w_ix, n_columns, line): token rows of another number of columns."""
    lines = _token_lines(sentences(docs)).filter(F.size("cells") != n_columns)
    return lines.select("doc_id", "sid", "w_ix", F.size("cells").alias("n_columns"), F.array_join("cells", "\t").alias("line"))


def outside(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, line): lines that stand where none should: in a field outside of sentences, in a document outside of fields."""
    doc_id = F.try_element_at("meta", F.lit("id")).alias("doc_id")
    no_fields = F.regexp_replace("content", r'(?s)<field name="[^"]*">.*?</field>', "")
    in_doc = docs.select(doc_id, F.lit("outside of fields").alias("rule"), F.explode(F.split(no_fields, r"\n")).alias("line"))
    fields = docs.select(doc_id, F.explode(F.regexp_extract_all("content", F.lit(r'(?s)<field name="[^"]*">(.*?)</field>'), F.lit(1))).alias("part"))
    in_field = fields.select("doc_id", F.lit("outside of sentences").alias("rule"), F.explode(F.split(F.regexp_replace("part", r"(?s)<s>.*?</s>", ""), r"\n")).alias("line"))
    rest = in_doc.unionByName(in_field).filter(F.trim("line") != "")
    return rest.filter(~F.col("line").rlike(r"^</?(p|g|doc)\b"))


def article_text(toks: DataFrame) -> DataFrame:
    """(doc_id, titel, stichwort, text): the words of each field in order."""
    words = lambda f, sep: F.array_join(F.transform(F.filter(F.col("all"), lambda x: x["field"] == f), lambda x: x["word"]), sep)
    listed = toks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("field", "s_ix", "w_ix", "word"))).alias("all"))
    return listed.select("doc_id", words("titel", " ").alias("titel"), words("stichwort", ", ").alias("stichwort"), words("inhalt", " ").alias("text"))

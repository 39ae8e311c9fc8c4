"""The property graph as node and edge tables, and their CSV files.

Every table has the columns of its file; files have no header. Defined cases: commas in texts become
semicolons, line breaks blanks, acute accents apostrophes; stop words go to the edges marked so, each
role by its own word; a word of several readings stands under the first; repeated triples of a
sentence are one node; empty tables write empty folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswerk.plans.storage import checked_rows

# Kind of edge by word class.
EDGES = {"NOUN": "NOUN", "ADJ": "ADJ", "VERB": "VERB", "ADV": "ADVERB"}
FIELDS = {"inhalt": "content", "stichwort": "keywords", "titel": "title"}


def clean(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.regexp_replace(text, r"\n", " "), ",´", ";'")


def document_nodes(headers: DataFrame, params: Column | None = None) -> DataFrame:
    """(docid, date, docsrc, ressort, region, parser_params)."""
    semicolons = lambda c: F.translate(F.coalesce(c, F.lit("")), ",", ";")
    return headers.select(F.col("id").alias("docid"), F.replace("datum", F.lit("-"), F.lit("")).alias("date"), "docsrc", semicolons(F.col("ressort2")).alias("ressort"), F.coalesce("region", F.lit("")).alias("region"), semicolons(params if params is not None else F.lit("")).alias("parser_params"))


def sentence_nodes(tokens: DataFrame) -> DataFrame:
    """(sid, original)."""
    words = F.sort_array(F.collect_list(F.struct("ix", F.coalesce("word", F.lit("")).alias("word"))))
    return tokens.groupBy("sid").agg(clean(F.array_join(words["word"], " ")).alias("original"))


def field_edges(tokens: DataFrame) -> DataFrame:
    """(part, sid, docid): in which part of its document a sentence stands."""
    part = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    return tokens.select(F.try_element_at(part, F.col("wert")).alias("part"), "sid", F.col("id_article").alias("docid")).filter("part is not null").distinct()


def word_mentions(tokens: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(sid, id_article, ix, word, etype, is_stop) of good words outside of entities; tokens as of wordclass.classified."""
    kind = F.create_map(*[F.lit(x) for pair in EDGES.items() for x in pair])
    out = tokens.filter("good and span is null").select("sid", "id_article", "ix", F.col("ent_id").alias("word"), F.try_element_at(kind, F.col("wclass")).alias("etype"))
    return _with_stop(out, stop)


def _with_stop(mentions: DataFrame, stop: DataFrame | None) -> DataFrame:
    if stop is None:
        return mentions.withColumn("is_stop", F.lit(False))
    listed = stop.select("word", F.lit(True).alias("is_stop")).distinct()
    return mentions.join(listed, "word", "left").withColumn("is_stop", F.coalesce("is_stop", F.lit(False)))


def polarity_mentions(mentions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """mentions with etype POS, NEG or NEUT, exactly one each, positive looked up first, and the valence, that of NEG with its sign turned."""
    polar = lexicon.filter("kind in ('POS', 'NEG')").groupBy("word").agg(F.max("kind").alias("kind"), F.max_by("value", "kind").alias("value"))
    out = mentions.drop("etype").join(polar, "word", "left")
    valence = F.when(F.col("kind") == "NEG", -F.col("value")).otherwise(F.col("value"))
    return out.withColumns({"etype": F.coalesce("kind", F.lit("NEUT")), "valence": valence}).drop("kind", "value")


def emotion_mentions(mentions: DataFrame, emotions: DataFrame) -> DataFrame:
    """mentions with etype the emotion: one row for each emotion of a word."""
    return mentions.drop("etype").join(emotions.select("word", F.col("kind").alias("etype")).distinct(), "word")


def entity_mentions(spans: DataFrame, sentences: DataFrame, names: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(sid, id_article, ix, word, etype, wid, is_stop): entity spans under their words; wid where they equal a name (pid, name)."""
    out = spans.filter("etype is not null").select("sid", "ix", F.col("entity").alias("word"), "etype").join(sentences, "sid")
    out = _with_stop(out, stop)
    if names is None:
        return out.withColumn("wid", F.lit(None).cast("string"))
    one = names.groupBy(F.col("name").alias("word")).agg(F.min("pid").alias("wid"))
    return out.join(one, "word", "left")


def svo_nodes(svo: DataFrame) -> DataFrame:
    """(nvn_id, sid, subj, verb, obj): one node a distinct triple of a sentence."""
    return svo.select("sid", "subj", "verb", "obj").distinct().select(F.concat_ws("-", "subj", "obj", "verb", "sid").alias("nvn_id"), "sid", "subj", "verb", "obj")


def svo_edges(nodes: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(role, nvn_id, word, is_stop): each role goes by its own word."""
    each = nodes.select("nvn_id", F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("word")) for r in ("subj", "verb", "obj")]))).alias("role", "word"))
    return _with_stop(each, stop).select("role", "nvn_id", "word", "is_stop")


def adjective_noun_nodes(pairs: DataFrame) -> DataFrame:
    """(an_id, sid, adjective, noun)."""
    return pairs.select("sid", "adjective", "noun").distinct().select(F.concat_ws("-", "adjective", "noun", "sid").alias("an_id"), "sid", "adjective", "noun")


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, sid, word) of noun chunks (sid, np, words)."""
    return chunks.select(F.concat_ws("-", F.col("np").cast("int"), "sid").alias("chunk_id"), "sid", F.explode(F.split("words", " ")).alias("word"))


def entity_nodes(vocabulary: DataFrame, names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(polarity, ent_id, label, wid, valence): entities by polarity of their label; negative valence has its sign turned.

    vocabulary: (entity, ent_id); names: (pid, name), by which an entity that is a pid is labelled.
    """
    label = names.groupBy(F.col("pid").alias("entity")).agg(F.min("name").alias("name"))
    out = vocabulary.join(label, "entity", "left").withColumn("label", F.coalesce("name", "entity"))
    polar = lexicon.filter("kind in ('POS', 'NEG')").groupBy(F.col("word").alias("key")).agg(F.max("kind").alias("kind"), F.max_by("value", "kind").alias("value"))
    out = out.withColumn("key", F.lower("label")).join(polar, "key", "left")
    valence = F.when(F.col("kind") == "NEG", -F.col("value")).otherwise(F.col("value"))
    return out.select(F.coalesce("kind", F.lit("NEUT")).alias("polarity"), "ent_id", clean("label").alias("label"), F.when(F.col("name").isNotNull(), F.col("entity")).alias("wid"), valence.alias("valence"))


#: Lexicon words that may be looked for inside of words.
MAX_PARTS = 10_000


def labelled_by_substring(words: DataFrame, lexicon: DataFrame, label: str) -> DataFrame:
    """(word, label): distinct words that contain a lexicon word, whatever their case; a lexicon beyond MAX_PARTS is refused."""
    keys = sorted({r[0] for r in checked_rows(lexicon.select(F.lower("word")).dropna().distinct(), MAX_PARTS, "the lexicon") if r[0]})
    hit = F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(F.lower("word"), k)) if keys else F.lit(False)
    return words.select("word").distinct().filter(hit).withColumn("label", F.lit(label))


def class_words(mentions: DataFrame) -> DataFrame:
    """(etype, word): the distinct words of each class."""
    return mentions.select("etype", "word").filter("word is not null").distinct()


def write_csv(table: DataFrame, path: str, partition_by: list[str] | None = None, sep: str = ",") -> None:
    """Files without a header; one folder a kind where asked."""
    writer = table.write.mode("errorifexists").option("sep", sep).option("header", "false").option("emptyValue", "")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_graph(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table in a folder of its name, edges in a folder a kind."""
    for name, table in tables.items():
        kinds = [c for c in ("etype", "is_stop", "part", "role", "polarity") if c in table.columns]
        write_csv(table, f"{folder}/{name}", kinds)

"""Named queries of the operators over the annotated corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswerk.functions import readability, text
from corpuswerk.operators import articles, gazetteer, graph, models, network, stats, svo, wordclass
from corpuswerk.operators.network import Documents, Network
from corpuswerk.plans import corpus
from corpuswerk.plans.storage import materialized
from corpuswerk.sinks import graph_files, graph_tables
from corpuswerk.sources import records, verticals
from corpuswerk.sources.tables import table
from corpuswerk.streaming import files

QUERIES = {}
META = ["docsrc", "mediatype", "region", "ressort2", "tokens", "year", "dupl"]
#: Person for the name forms: first name, surname, short form, title.
PERSON = ("Josef", "Türtklonwalder", "jtw", "Dr.")
CENTER = "gewerkschaft glurosreul"


def query(f):
    QUERIES[f.__name__] = f
    return f


# Metadata and counters


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return stats.as_meta(corpus.headers(spark, d), *META)


@query
def count_meta(spark: SparkSession, d: str) -> DataFrame:
    return stats.count_by_meta(_meta(spark, d), "docsrc", "mediatype")


@query
def count_meta_transformed(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(F.split("ressort2", ","), lambda x: F.trim(x))
    return stats.count_by_meta(_meta(spark, d), "ressort2", transform={"section": parts})


@query
def sum_tokens_meta(spark: SparkSession, d: str) -> DataFrame:
    return stats.sum_by_meta(_meta(spark, d), "docsrc", "year")


@query
def avg_tokens_meta(spark: SparkSession, d: str) -> DataFrame:
    return stats.mean_by_meta(_meta(spark, d), "docsrc").withColumn("mean_tokens", F.round("mean_tokens", 6))


@query
def meta_keys(spark: SparkSession, d: str) -> DataFrame:
    return stats.count_meta_keys(_meta(spark, d))


@query
def text_counters(spark: SparkSession, d: str) -> DataFrame:
    return stats.text_counters(corpus.tokens(spark, d, "word"))


@query
def text_counters_by_source(spark: SparkSession, d: str) -> DataFrame:
    return stats.text_counters(corpus.tokens(spark, d, "word", "docsrc"), "docsrc")


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("docid is not null")
    path = F.concat(F.lit("/data/"), F.lower("source"), F.lit("/"), F.split("docid", "_")[0], F.lit("_"), F.split("docid", "_")[1])
    return records.path_parts(t.select(path.alias("path"), F.coalesce("n_chars", F.lit(0)).alias("size")), prefix="/data/")


@query
def path_extract(spark: SparkSession, d: str) -> DataFrame:
    return _inventory(spark, d).select("path", "main", "source", F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("year").cast("bigint").alias("year")).distinct()


@query
def inventory_by_source(spark: SparkSession, d: str) -> DataFrame:
    return stats.inventory_counts(_inventory(spark, d), "source")


@query
def inventory_by_year(spark: SparkSession, d: str) -> DataFrame:
    return stats.inventory_counts(_inventory(spark, d).withColumn("year", F.col("year").cast("bigint")), "year").orderBy("n_files")


@query
def inventory_batches(spark: SparkSession, d: str) -> DataFrame:
    paths = _inventory(spark, d).select("path").distinct()
    return records.slices(paths, 50, ["path"]).select("path", F.col("batch").cast("bigint").alias("batch"))


# Readability


def _counted(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    t = table(spark, d, "documents").filter(F.lower(F.trim("lang")).isin("de", "en", "es", "fr") & F.col("text").isNotNull())
    t = t.select("doc_id", F.lower(F.trim("lang")).alias("lang"), "text", words.alias("words"))
    syllables = F.transform("words", lambda w: text.n_syllables(w))
    t = t.withColumn("syl", syllables)
    size = lambda c: F.size(c).cast("bigint")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return t.select(
        "doc_id", "lang", size("words").alias("n_words"), total(F.transform("words", lambda w: F.length(w).cast("bigint"))).alias("n_chars"), total(F.transform("syl", lambda n: n.cast("bigint"))).alias("n_syll"),
        size(F.filter("words", lambda w: F.length(w) >= 7)).alias("n_long"), size(F.filter("syl", lambda n: n >= 3)).alias("n_poly"), size(F.filter("syl", lambda n: n == 1)).alias("n_mono"),
        F.greatest(F.lit(1), size(F.regexp_extract_all("text", F.lit("[.!?]+"), F.lit(0)))).alias("n_sents"),
    )


@query
def readability_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d)


@query
def flesch(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).select("doc_id", F.round(readability.flesch_reading_ease("n_syll", "n_words", "n_sents", "lang"), 6).alias("score"))


def _wiener(variant: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _counted(spark, d).select("doc_id", F.round(readability.wiener_sachtextformel("n_words", "n_poly", "n_mono", "n_long", "n_sents", variant), 6).alias("score"))

    return run


for _v in readability.WIENER:
    QUERIES[f"wiener_v{_v}"] = _wiener(_v)


@query
def lix(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).select("doc_id", F.round(readability.lix("n_words", "n_long", "n_sents"), 6).alias("score"))


@query
def ari(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).select("doc_id", F.round(readability.automated_readability_index("n_chars", "n_words", "n_sents"), 6).alias("score"))


# Text functions


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _first_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph of the texts as a row, so that what stands at its beginning or end is found."""
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))


def _digest(words) -> DataFrame:
    return F.md5(F.array_join(words, "\u0001")).alias("digest")


@query
def attached_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(text.attach_punctuation("text")).alias("digest"))


@query
def only_words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(text.only_words(text.collapse_blanks("text"))).alias("digest"))


@query
def subtitles(spark: SparkSession, d: str) -> DataFrame:
    return _first_lines(spark, d).select("doc_id", "p", text.subtitle("text").alias("s")).filter("s.subtitle is not null").select("doc_id", F.col("p").cast("bigint").alias("p"), "s.subtitle", "s.rest")


@query
def datelines(spark: SparkSession, d: str) -> DataFrame:
    return _first_lines(spark, d).select("doc_id", "p", text.dateline("text").alias("s")).filter("s.place is not null").select("doc_id", F.col("p").cast("bigint").alias("p"), "s.place", "s.agency", F.md5("s.rest").alias("digest"))


@query
def final_notes(spark: SparkSession, d: str) -> DataFrame:
    return _first_lines(spark, d).select("doc_id", "p", text.final_note("text").alias("s")).filter("s.note is not null").select("doc_id", F.col("p").cast("bigint").alias("p"), "s.note", F.md5("s.rest").alias("digest"))


@query
def wordpunct_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.wordpunct_tokens("text").alias("t")).select("doc_id", F.when(F.col("t").isNotNull(), F.size("t")).cast("bigint").alias("n"), _digest("t"))


@query
def good_words(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tokens(spark, d, "word").filter(text.is_good_word("word")).groupBy("word").agg(F.count("*").alias("n"))


@query
def filtered_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _digest(text.filter_sentences("text")))


@query
def regex_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _digest(text.regex_tokens("text")))


@query
def without_stop_words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _digest(text.without_stop_words(text.regex_tokens("text"), ["die", "der", "das", "und", "Mit"])))


@query
def embedding_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(text.embedding_sentences("text")).alias("s")).select("doc_id", F.array_join("s", " ").alias("sentence")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("sentence").alias("longest"))


@query
def normalised_names(spark: SparkSession, d: str) -> DataFrame:
    normal = text.normalise_names("text", [PERSON])
    return _docs(spark, d).select("doc_id", F.size(F.regexp_extract_all(normal, F.lit("Türtklonwalder"), F.lit(0))).cast("bigint").alias("n")).filter("n > 0")


@query
def article_text(spark: SparkSession, d: str) -> DataFrame:
    t = corpus.tokens(spark, d, "id_article", "wert", "word").filter("wert = 'inhalt'")
    return t.groupBy("id_article").agg(F.md5(text.joined_words(F.coalesce("word", F.lit("")), "sid", "ix")).alias("digest"))


@query
def article_keywords(spark: SparkSession, d: str) -> DataFrame:
    t = corpus.tokens(spark, d, "id_article", "wert", "word").filter("wert = 'stichwort'")
    return t.groupBy("id_article").agg(text.joined_words(F.coalesce("word", F.lit("")), "sid", "ix", sep=", ").alias("keywords"))


@query
def parsed_articles(spark: SparkSession, d: str) -> DataFrame:
    out = articles.parsed(_docs(spark, d))
    return out.select("doc_id", "subtitle", "place", "agency", "note", F.md5("body").alias("body"), F.size("tokens").cast("bigint").alias("n_tokens"))


def _marked_up(spark: SparkSession, d: str) -> DataFrame:
    """The texts as files of one document each, their lines as paragraphs."""
    t = table(spark, d, "documents").filter("text is not null and docid is not null and not contains(text, '<')")
    head = F.format_string('<file><doc id="%s" docsrc="%s" ressort2="%s">', "docid", "source", F.coalesce("ressort2", F.lit("")))
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    return articles.documents(t.select(F.col("docid").alias("path"), F.concat(head, F.array_join(lines, "\n"), F.lit("</doc></file>")).alias("text")))


@query
def document_texts(spark: SparkSession, d: str) -> DataFrame:
    return articles.document_texts(_marked_up(spark, d)).select(F.try_element_at("meta", F.lit("id")).alias("id"), F.md5("text").alias("digest"))


@query
def filtered_documents(spark: SparkSession, d: str) -> DataFrame:
    return articles.document_texts(articles.having_any(_marked_up(spark, d), ["sport", "NBLK"])).select(F.try_element_at("meta", F.lit("id")).alias("id"))


@query
def paragraph_rows(spark: SparkSession, d: str) -> DataFrame:
    return articles.paragraph_rows(_marked_up(spark, d)).select(F.try_element_at("meta", F.lit("id")).alias("id"), F.col("p_ix").cast("bigint").alias("p_ix"), F.md5("paragraph").alias("digest"))


@query
def long_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return articles.paragraphs_with(_marked_up(spark, d), ["id", "docsrc", "ressort2"]).groupBy("docsrc", "ressort2").agg(F.count("*").alias("n"))


@query
def document_attributes(spark: SparkSession, d: str) -> DataFrame:
    return articles.attribute_rows(_marked_up(spark, d)).groupBy("key", "value").agg(F.count("*").alias("n")).filter("key <> 'id'")


@query
def markup_pieces(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "vertical_lines").filter("raw_line is not null")
    return lines.select("line_id", F.posexplode(text.markup_pieces("raw_line")).alias("at", "piece")).groupBy("line_id").agg(F.count("*").alias("n"), F.sum(F.length("piece")).alias("n_chars"))


@query
def paragraph_nouns(spark: SparkSession, d: str) -> DataFrame:
    out = articles.words_of(corpus.tokens(spark, d, "id_article", "wert", "word", "posTT"), ["id_article", "wert"], F.col("posTT") == "NN")
    return out.select("id_article", "wert", F.array_join("words", " ").alias("words"))


# Word classes, spans and the vocabulary


@query
def word_classes(spark: SparkSession, d: str) -> DataFrame:
    return corpus.classified(spark, d).groupBy("wclass", "good").agg(F.count("*").alias("n"))


@query
def word_class_tokens(spark: SparkSession, d: str) -> DataFrame:
    return corpus.classified(spark, d).select("sid", F.col("ix").cast("bigint").alias("ix"), "wclass", "ent_id")


@query
def class_scores(spark: SparkSession, d: str) -> DataFrame:
    t = corpus.tokens(spark, d).select(F.posexplode(wordclass.class_scores()).alias("class", "score"))
    return t.groupBy(F.col("class").cast("bigint").alias("class")).agg(F.sum("score").alias("score"))


@query
def iob_spans(spark: SparkSession, d: str) -> DataFrame:
    return wordclass.entity_spans(corpus.tokens(spark, d, "word", "ner", "iob")).select("sid", F.col("ix").cast("bigint").alias("ix"), "etype", "entity")


@query
def span_counts(spark: SparkSession, d: str) -> DataFrame:
    return wordclass.span_counts(corpus.tokens(spark, d, "word", "ner", "iob"))


@query
def noun_chunks(spark: SparkSession, d: str) -> DataFrame:
    return wordclass.noun_chunks(corpus.tokens(spark, d), keep_last=False).select("sid", F.col("first_ix").cast("bigint").alias("first_ix"), F.col("np").cast("bigint").alias("np"), "words")


@query
def entity_vocab_ids(spark: SparkSession, d: str) -> DataFrame:
    return wordclass.entity_vocabulary(corpus.tokens(spark, d))


@query
def negated_verbs(spark: SparkSession, d: str) -> DataFrame:
    return wordclass.negated_verbs(corpus.tokens(spark, d)).select("sid", F.col("ix").cast("bigint").alias("ix"))


@query
def verb_spans(spark: SparkSession, d: str) -> DataFrame:
    return wordclass.dependent_spans(corpus.tokens(spark, d), "ng", "VERB").select("sid", *[F.col(c).cast("bigint").alias(c) for c in ("ix", "from_ix", "to_ix")])


@query
def tree_children(spark: SparkSession, d: str) -> DataFrame:
    t = corpus.tokens(spark, d, "ixDEP")
    right = svo.children(t, "right").groupBy("sid", "head").agg(F.count("*").alias("n_right"))
    left = svo.children(t, "left").groupBy("sid", "head").agg(F.count("*").alias("n_left"))
    return right.join(left, ["sid", "head"], "full").select("sid", F.col("head").cast("bigint").alias("head"), F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


# Networks


def _networks(spark: SparkSession, d: str, *parts: str) -> tuple[DataFrame, DataFrame]:
    return materialized(corpus.mentions(spark, d, *parts), "mentions"), corpus.documents(spark, d)


@query
def cooc_sentence(spark: SparkSession, d: str) -> DataFrame:
    return network.sentence_network(*_networks(spark, d, "words"), Network(freq=1))


@query
def cooc_sentence_stop(spark: SparkSession, d: str) -> DataFrame:
    return network.sentence_network(*_networks(spark, d, "words"), Network(pos1=("NOUN",), pos2=("ADJ", "VERB"), stop_words=True, freq=2))


@query
def cooc_same_kinds(spark: SparkSession, d: str) -> DataFrame:
    return network.sentence_network(*_networks(spark, d, "words", "entities"), Network(pos1=("LOC", "ORG"), pos2=("ORG", "PER"), freq=1))


@query
def cooc_paragraph(spark: SparkSession, d: str) -> DataFrame:
    m, docs = _networks(spark, d, "entities")
    part = corpus.tokens(spark, d, "wert").groupBy("sid").agg(F.min("wert").alias("wert"))
    return network.paragraph_network(m.join(part, "sid"), docs, Network(pos1=("PER", "LOC", "ORG"), pos2=("PER", "LOC", "ORG"), freq=1), ["doc_id", "wert"])


@query
def cooc_center(spark: SparkSession, d: str) -> DataFrame:
    m, docs = _networks(spark, d, "words", "entities")
    return network.sentence_network(m.withColumn("word", F.lower("word")), docs, Network(pos1=("ORG",), pos2=("NOUN", "VERB"), center=CENTER, freq=1))


@query
def cooc_date_range(spark: SparkSession, d: str) -> DataFrame:
    which = Documents(start=20150101, end=20171231, sections=["politik", "sport"])
    return network.sentence_network(*_networks(spark, d, "words"), Network(freq=1, documents=which))


@query
def cooc_one_day(spark: SparkSession, d: str) -> DataFrame:
    return network.sentence_network(*_networks(spark, d, "words"), Network(freq=1, documents=Documents(date=20170506, sources=["NBLK", "TKUR", "LAFU", "HOPO", "WIRU"])))


@query
def cooc_wid(spark: SparkSession, d: str) -> DataFrame:
    return network.sentence_network(*_networks(spark, d, "words", "entities"), Network(pos1=("LOC", "NOUN"), pos2=("LOC", "NOUN"), has_wid=True, freq=1))


@query
def occurrence(spark: SparkSession, d: str) -> DataFrame:
    return network.occurrences(*_networks(spark, d, "words", "entities"), Network(pos1=("NOUN", "LOC", "ORG"), freq=2))


@query
def entity_freq_distinct(spark: SparkSession, d: str) -> DataFrame:
    return network.sentence_frequency(*_networks(spark, d, "words", "entities"), Documents(), word="verein")


@query
def entity_freq_wid(spark: SparkSession, d: str) -> DataFrame:
    m, docs = _networks(spark, d, "entities")
    return m.filter("wid is not null").groupBy("wid").agg(F.count_distinct("sid").alias("n_sentences"))


@query
def assoc_adjectives(spark: SparkSession, d: str) -> DataFrame:
    return network.adjective_network(network.adjective_nouns(corpus.classified(spark, d)))


@query
def assoc_adjectives_entities(spark: SparkSession, d: str) -> DataFrame:
    t = corpus.classified(spark, d)
    entities = wordclass.entity_spans(corpus.tokens(spark, d, "word", "ner", "iob")).select("sid")
    return network.adjective_network(network.adjective_nouns(t), entities=entities, stop=corpus.STOP)


@query
def sna_best_label(spark: SparkSession, d: str) -> DataFrame:
    return network.sentiment_network(*_networks(spark, d, "words", "polarity"), Network(freq=1))


@query
def sna_ranked(spark: SparkSession, d: str) -> DataFrame:
    m, docs = _networks(spark, d, "words", "polarity")
    pairs = network.sentence_pairs(m, docs, Network(freq=1)).join(network.sentence_valence(m), "sid", "left")
    label = F.when(F.col("balance") > 0, "Positive").when(F.col("balance") < 0, "Negative").otherwise("Neutral")
    counted = pairs.withColumn("valence", label).groupBy("n1", "n2", "valence").agg(F.sum("w").alias("weight"))
    return network.best_by_window(counted, ["n1", "n2"], "valence", "weight", 2).withColumn("rank", F.col("rank").cast("bigint"))


@query
def emotion_weight(spark: SparkSession, d: str) -> DataFrame:
    return network.emotion_network(*_networks(spark, d, "words", "emotions"), Network(freq=1), ["FREUDE", "FURCHT"])


@query
def max_emotion(spark: SparkSession, d: str) -> DataFrame:
    return network.main_emotion_network(*_networks(spark, d, "words", "emotions"), Network(freq=1), ["FREUDE", "FURCHT", "TRAUER", "WUT"])


@query
def valence_pairs(spark: SparkSession, d: str) -> DataFrame:
    return network.valence_network(*_networks(spark, d, "words", "polarity"), Network(freq=1), ["POS"])


@query
def valence_sum(spark: SparkSession, d: str) -> DataFrame:
    return network.sentence_valence(corpus.mentions(spark, d, "polarity")).withColumn("balance", F.round("balance", 6))


@query
def pos_neg_neu_split(spark: SparkSession, d: str) -> DataFrame:
    return corpus.mentions(spark, d, "polarity").groupBy("etype").agg(F.count("*").alias("n"))


@query
def emotion_mentions(spark: SparkSession, d: str) -> DataFrame:
    return corpus.mentions(spark, d, "emotions").groupBy("etype", "word").agg(F.count("*").alias("n"))


@query
def stopword_flag(spark: SparkSession, d: str) -> DataFrame:
    return corpus.mentions(spark, d, "words").groupBy("etype", "is_stop").agg(F.count("*").alias("n"))


@query
def top_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return network.top_words(corpus.mentions(spark, d, "words"), 20)


# Subject, verb and object


def _triples(spark: SparkSession, d: str) -> DataFrame:
    return svo.triples(corpus.classified(spark, d))


@query
def svo_triples(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).select("sid", F.col("verb_ix").cast("bigint").alias("verb_ix"), "subj", "verb", "obj")


@query
def svo_pairs(spark: SparkSession, d: str) -> DataFrame:
    return network.svo_sentiment_network(_triples(spark, d), *_networks(spark, d, "words", "polarity"), Network(freq=0))


@query
def svo_polarity(spark: SparkSession, d: str) -> DataFrame:
    return network.svo_polarity_network(_triples(spark, d), *_networks(spark, d, "words", "polarity"), Network(freq=0), "NEG")


@query
def svo_list_example(spark: SparkSession, d: str) -> DataFrame:
    return network.triples_of(_triples(spark, d), graph_tables.sentence_nodes(corpus.tokens(spark, d, "word")), "lohnpreis")


@query
def svo_list_example_object(spark: SparkSession, d: str) -> DataFrame:
    return network.triples_of(_triples(spark, d), graph_tables.sentence_nodes(corpus.tokens(spark, d, "word")), "lohnpreis", as_object=True)


@query
def svo_lists(spark: SparkSession, d: str) -> DataFrame:
    t = svo.as_lists(_triples(spark, d))
    return t.groupBy("verb", F.array_join("subj", ",").alias("subj"), F.array_join("obj", ",").alias("obj")).agg(F.count("*").alias("n"))


@query
def svo_lookup(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([("lohnpreis",), ("verein",), ("jugendvertrag",)], "word string")
    return svo.lookup(svo.as_lists(_triples(spark, d)), words).groupBy("word", "other", "whole").agg(F.count("*").alias("n"))


@query
def svo_partners(spark: SparkSession, d: str) -> DataFrame:
    return svo.partners(svo.as_lists(_triples(spark, d)), "lohnpreis").groupBy("other").agg(F.count("*").alias("n"))


@query
def svo_split(spark: SparkSession, d: str) -> DataFrame:
    return svo.split_by_polarity(svo.as_lists(_triples(spark, d)), corpus.polarity(spark)).groupBy("polarity", "verb").agg(F.count("*").alias("n"))


@query
def so_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return svo.subject_object_pairs(svo.as_lists(_triples(spark, d)), corpus.polarity(spark)).groupBy("polarity", "subj", "obj").agg(F.count("*").alias("n"))


@query
def neutral_verbs(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([("lohnpreis",), ("verein",), ("jugendvertrag",)], "word string")
    return svo.neutral_verbs(svo.as_lists(_triples(spark, d)), words, corpus.polarity(spark))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return svo.subject_object_pairs(svo.as_lists(_triples(spark, d)), corpus.polarity(spark)).select("subj", "obj")


@query
def pair_partners(spark: SparkSession, d: str) -> DataFrame:
    return svo.pair_partners(_pairs(spark, d), "lohnpreis").groupBy("other").agg(F.count("*").alias("n"))


@query
def svo_bfs_depth2(spark: SparkSession, d: str) -> DataFrame:
    return svo.neighbourhood(_pairs(spark, d), ["lohnpreis", "verein"], 2)


# Gazetteer


@query
def lookup_table(spark: SparkSession, d: str) -> DataFrame:
    return gazetteer.lookup_table(corpus.names(spark, d)).select("tok", "pid", F.col("plen").cast("bigint").alias("plen"), F.col("pos").cast("bigint").alias("pos"))


@query
def gazetteer_match(spark: SparkSession, d: str) -> DataFrame:
    found = gazetteer.runs(corpus.tokens(spark, d, "word"), gazetteer.lookup_table(corpus.names(spark, d)))
    return found.select("sid", F.col("start").cast("bigint").alias("start"), F.col("plen").cast("bigint").alias("plen"), "pid")


@query
def linked_places(spark: SparkSession, d: str) -> DataFrame:
    found = gazetteer.link_names(corpus.tokens(spark, d, "word"), table(spark, d, "gazetteer").filter("kind = 'place'"))
    return found.select("sid", F.col("start").cast("bigint").alias("start"), F.col("plen").cast("bigint").alias("plen"), "pid")


@query
def linked_persons(spark: SparkSession, d: str) -> DataFrame:
    people = materialized(corpus.persons(spark, d), "people")
    politicians = people.filter("views >= 6").select("pid")
    return gazetteer.link_persons(corpus.tokens(spark, d, "word", "id_article"), people, politicians)


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = corpus.tokens(spark, d)
    people = materialized(corpus.persons(spark, d), "people")
    return t, materialized(gazetteer.link(t, table(spark, d, "gazetteer"), people), "spans")


@query
def settled_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d)[1]


@query
def enriched_tokens(spark: SparkSession, d: str) -> DataFrame:
    t, spans = _spans(spark, d)
    rows = gazetteer.enriched(t, spans)
    return graph_files.enriched_lines(rows, ["word", "pos", "posTT", "lemma", "ix", "posUDS", "posTI", "ner", "iob", "ent_id", "ent_type", "ent_iob", "ixNP", "dep", "ixDEP"])


@query
def candidate_freq(spark: SparkSession, d: str) -> DataFrame:
    t, spans = _spans(spark, d)
    return gazetteer.candidate_frequency(spans, t)


@query
def person_names(spark: SparkSession, d: str) -> DataFrame:
    firsts, lasts = gazetteer.person_names(corpus.persons(spark, d))
    return firsts.withColumn("part", F.lit("first")).unionByName(lasts.withColumn("part", F.lit("last")))


@query
def merged_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gazetteer")
    return gazetteer.merged_vocabulary(g.select("pid", "label"), g.filter("kind = 'org'").select("pid", F.upper("label").alias("label")))


# Graphs


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Nouns that share sentences, twice and more."""
    return materialized(cooc_sentence(spark, d).filter("weight >= 2").select(F.col("n1").alias("src"), F.col("n2").alias("dst"), "weight"), "noun_edges")


@query
def clique_edges(spark: SparkSession, d: str) -> DataFrame:
    t = corpus.mentions(spark, d, "words").filter("etype = 'NOUN'")
    return graph.clique_edges(t, ["sid"], "ix", "word")


@query
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.numbered_vertices(_edges(spark, d))


@query
def multi_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.parallel_edges(_edges(spark, d)).withColumn("n", F.col("n").cast("bigint"))


@query
def undirected_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected(clique_edges(spark, d))


@query
def degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


@query
def graph_overview(spark: SparkSession, d: str) -> DataFrame:
    return graph.overview(_edges(spark, d)).withColumn("density", F.round("density", 9))


@query
def graph_cut_off(spark: SparkSession, d: str) -> DataFrame:
    return graph.cut_off(_edges(spark, d), 3, 2)


@query
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    e = materialized(_pairs(spark, d).distinct().select(F.col("subj").alias("src"), F.col("obj").alias("dst")), "svo_pairs")
    return graph.large_components(graph.vertices(e), e, 2)


@query
def community_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(_edges(spark, d))


@query
def community_between_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    labels = graph.vertices(e).select("node", F.substring("node", 1, 1).alias("community"))
    return graph.between_communities(e, labels)


@query
def node_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_sizes(corpus.mentions(spark, d, "words").groupBy(F.col("word").alias("node")).agg(F.count("*").alias("n")))


@query
def gexf(spark: SparkSession, d: str) -> DataFrame:
    return graph_files.gexf_lines(_edges(spark, d).withColumn("valence", F.when(F.col("weight") > 2, "often").otherwise("rare")), {"often": (200, 0, 0)}, "valence", 3)


@query
def graphml(spark: SparkSession, d: str) -> DataFrame:
    return graph_files.graphml_lines(_edges(spark, d))


# Graph tables


@query
def graph_documents(spark: SparkSession, d: str) -> DataFrame:
    return graph_tables.document_nodes(corpus.headers(spark, d))


@query
def graph_sentences(spark: SparkSession, d: str) -> DataFrame:
    return graph_tables.sentence_nodes(corpus.tokens(spark, d, "word"))


@query
def graph_field_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph_tables.field_edges(corpus.tokens(spark, d, "wert", "id_article"))


@query
def graph_mentions(spark: SparkSession, d: str) -> DataFrame:
    return corpus.mentions(spark, d).select("sid", "doc_id", F.col("ix").cast("bigint").alias("ix"), "word", "etype", "is_stop", "wid", "valence")


@query
def graph_svo_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph_tables.svo_edges(graph_tables.svo_nodes(_triples(spark, d)), corpus.stop(spark))


@query
def graph_adjective_nouns(spark: SparkSession, d: str) -> DataFrame:
    return graph_tables.adjective_noun_nodes(network.adjective_nouns(corpus.classified(spark, d)))


@query
def graph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return graph_tables.chunk_nodes(wordclass.noun_chunks(corpus.tokens(spark, d), keep_last=False))


@query
def graph_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph_tables.entity_nodes(wordclass.entity_vocabulary(corpus.tokens(spark, d)), corpus.names(spark, d), corpus.polarity(spark))


@query
def graph_class_words(spark: SparkSession, d: str) -> DataFrame:
    return graph_tables.class_words(corpus.mentions(spark, d, "words"))


@query
def labelled_by_substring(spark: SparkSession, d: str) -> DataFrame:
    return graph_tables.labelled_by_substring(corpus.mentions(spark, d, "words"), corpus.polarity(spark).filter("kind = 'NEG'"), "Negative")


# Files


def _files(spark: SparkSession, d: str) -> DataFrame:
    return verticals.joined_lines(table(spark, d, "vertical_lines").filter("raw_line is not null"))


@query
def vertical_headers(spark: SparkSession, d: str) -> DataFrame:
    return verticals.headers(verticals.documents(_files(spark, d))).select("path", F.col("id_article").cast("bigint").alias("id_article"), "id", "docsrc", "tokens")


@query
def vertical_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = verticals.tokens(verticals.documents(_files(spark, d)))
    return t.select("sid", F.col("w_ix").cast("bigint").alias("w_ix"), "word", "ix", "ixDEP", "ner", "lemma")


@query
def vertical_malformed(spark: SparkSession, d: str) -> DataFrame:
    return verticals.malformed(verticals.documents(_files(spark, d))).select("sid", F.col("n_columns").cast("bigint").alias("n_columns"))


@query
def vertical_outside(spark: SparkSession, d: str) -> DataFrame:
    return verticals.outside(verticals.documents(_files(spark, d)))


@query
def vertical_articles(spark: SparkSession, d: str) -> DataFrame:
    return verticals.article_text(verticals.tokens(verticals.documents(_files(spark, d))))


# Sets, statements, windows


@query
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    g, m = corpus.names(spark, d).select(F.col("name").alias("word")).distinct(), corpus.mentions(spark, d, "entities").select("word").distinct()
    part = lambda df, name: df.select(F.lit(name).alias("part"), "word")
    return part(g.intersect(m), "both").unionByName(part(g.join(m, "word", "left_anti"), "gazetteer")).unionByName(part(m.join(g, "word", "left_anti"), "text")).groupBy("part").agg(F.count("*").alias("n"))


def _statements(spark: SparkSession, d: str) -> DataFrame:
    nation, region, customer = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "customer")
    rows = nation.select(F.concat(F.lit("N"), "n_nationkey").alias("s"), F.lit("P279").alias("p"), F.concat(F.lit("R"), "n_regionkey").alias("o"))
    rows = rows.unionByName(region.select(F.concat(F.lit("R"), "r_regionkey").alias("s"), F.lit("P279").alias("p"), F.lit("WORLD").alias("o")))
    rows = rows.unionByName(customer.select(F.concat(F.lit("C"), "c_custkey").alias("s"), F.lit("P31").alias("p"), F.concat(F.lit("N"), "c_nationkey").alias("o")))
    return rows.unionByName(customer.select(F.concat(F.lit("C"), "c_custkey").alias("s"), F.lit("label").alias("p"), F.col("c_name").alias("o")))


@query
def subclass_closure(spark: SparkSession, d: str) -> DataFrame:
    return records.subclasses(_statements(spark, d), ["WORLD"])


@query
def typed_entities(spark: SparkSession, d: str) -> DataFrame:
    return records.typed_entities(_statements(spark, d), {"HERE": ["R0", "R1"], "THERE": ["R2"]})


@query
def entity_records(spark: SparkSession, d: str) -> DataFrame:
    out = records.entity_records(_statements(spark, d), "label", {"classes": "P31", "above": "P279"})
    return out.select("s", "label", F.array_join("classes", ";").alias("classes"), F.size("above").cast("bigint").alias("n_above"))


@query
def joined_values(spark: SparkSession, d: str) -> DataFrame:
    return records.joined_values(corpus.headers(spark, d).select("docsrc", "mediatype"), "docsrc", "mediatype")


@query
def fixed_dates(spark: SparkSession, d: str) -> DataFrame:
    return corpus.headers(spark, d).select("id", F.date_format(text.iso_date("datum_full"), "yyyy-MM-dd").alias("date"))


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = files.windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "kind", "n")


# Models


@query
def topn_similar(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return models.most_similar(v, v.filter("vec_id = 7"), 50, [7], "vec_id").withColumn("similarity", F.round("similarity", 4))


@query
def analogy_vector(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return models.analogies(v, [1, 2, 3], 20, key="vec_id").withColumn("similarity", F.round("similarity", 4))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.explode(text.embedding_sentences("text")).alias("words"))


@query
def word2vec_similar(spark: SparkSession, d: str) -> DataFrame:
    model = models.word_vectors(_sentences(spark, d), size=16, min_count=5)
    vectors = models.vector_table(model)
    return models.most_similar(vectors, vectors.filter("word = 'sagt'"), 20, ["sagt"])


@query
def lda_topics(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    vectors, pipeline = models.count_vectors(docs, min_df=20)
    return models.topic_terms(models.topics(vectors, k=3, max_iter=3), pipeline.stages[-1].vocabulary, 20)


@query
def gram_vectors(spark: SparkSession, d: str) -> DataFrame:
    return models.gram_vectors(corpus.names(spark, d).select(F.col("name").alias("word")))


@query
def reduced_vectors(spark: SparkSession, d: str) -> DataFrame:
    return models.reduced(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector")), 10).select("vec_id", "reduced")

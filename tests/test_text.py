import pytest
from pyspark.sql import functions as F

from corpuswerk.functions import readability, text
from corpuswerk.operators import articles


def one(spark, column, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("y")).first()["y"]


def test_article_parts(spark):
    assert tuple(one(spark, text.subtitle("x"), "Titel Utl.: Neues Amt = Der Rest")) == ("Neues Amt", " Der Rest"[1:])
    assert tuple(one(spark, text.subtitle("x"), "ohne = Utl.")) == (None, "ohne = Utl.")
    assert tuple(one(spark, text.dateline("x"), "BAD ÖD (APA/dpa) - Am Montag")) == ("BAD ÖD", "APA/dpa", "Am Montag")
    assert tuple(one(spark, text.dateline("x"), "Am Montag (APA)")) == (None, None, "Am Montag (APA)")
    # The note is cut off, not the whole text, whichever phrase it is.
    assert tuple(one(spark, text.final_note("x"), "Der Text Seite 3")) == ("Seite 3", "Der Text ")
    assert tuple(one(spark, text.final_note("x"), "Der Text Bild 7")) == ("Bild 7", "Der Text ")
    assert one(spark, text.subtitle("x"), None)["subtitle"] is None


def test_cleaning_and_tokens(spark):
    assert one(spark, text.attach_punctuation("x"), "Ja , ( so ) *ist* es !") == "Ja, (so) ist es!"
    assert one(spark, text.only_words("x"), "Öl, a Über-mut") == "Öl Über mut"
    assert one(spark, text.collapse_blanks("x"), "a  \n b") == "a b"
    assert one(spark, text.wordpunct_tokens("x"), "Öl (neu)... ja") == ["Öl", "(", "neu", ")...", "ja"]
    assert one(spark, text.filter_sentences("x"), "Ein Satz. Über-mut; ja!\nZwei") == ["Ein", "Satz", "Über-mut", "ja", "Zwei"]
    assert one(spark, text.regex_tokens("x"), "Die Über-Maß, ja 12ab") == ["die", "über-maß"]
    assert one(spark, text.without_stop_words("x", ["die"]), ["Die", "x", "die", "x"], "x array<string>") == ["x", "x"]
    assert one(spark, text.embedding_sentences("x"), "Das Haus ist so. Ja!") == [["das", "haus", "ist"]]
    assert one(spark, text.wordpunct_tokens("x"), "") == []


@pytest.mark.parametrize("word, good", [("a-", False), ("-a", False), ("U.S.", False), ("1.", True), ("a-b", True), ("x", False), ("Öl", True), ("", False), ("a-b-", True), ("ab!", False)])
def test_good_words(spark, word, good):
    assert one(spark, text.is_good_word("x"), word) is good


def test_names_and_markup(spark):
    people = [("Josef", "Van der Hof", "vdh", "Dr."), ("Anna", "Berg", "", "")]
    assert one(spark, text.normalise_names("x", people), "Dr. Josef van der Hof und J. Van der Hofs, vdh; Bergen, Bergs Anna Berg!") == "Vanderhof und Vanderhof, Vanderhof; Bergen, Berg Berg!"
    files = '<file><doc id="1" id="2" x="y"><p>Eins</p>\n<p>zwei</p></doc><doc id="3"></doc></file>'
    docs = one(spark, text.documents_of("x"), files)
    assert [d["meta"] for d in docs] == [{"id": "2", "x": "y"}, {"id": "3"}]
    assert one(spark, text.paragraphs_of("x"), docs[0]["content"]) == ["Eins", "zwei"]
    for markup in (files, "a < b <i>c</i>\n<", ""):
        assert "".join(one(spark, text.markup_pieces("x"), markup)) == markup
    assert str(one(spark, text.iso_date("x"), "2016-02-30T00:00:00")) == "0001-01-01" and str(one(spark, text.iso_date("x"), "2016-02-03T00:00:00")) == "2016-02-03"
    assert one(spark, text.padded("x", 3), [5], "x array<bigint>") == [0, 0, 5]


def test_readability_by_hand(spark):
    counts = spark.createDataFrame([(500, 160, 100, 30, 60, 15, 5, "de "), (0, 0, 0, 0, 0, 0, 1, None)], "chars int, syll int, words int, long int, mono int, poly int, sents int, lang string")
    scores = counts.select(
        readability.flesch_reading_ease("syll", "words", "sents", "lang").alias("f"), readability.wiener_sachtextformel("words", "poly", "mono", "long", "sents", 1).alias("w1"), readability.wiener_sachtextformel("words", "poly", "mono", "long", "sents", 4).alias("w4"),
        readability.lix("words", "long", "sents").alias("lix"), readability.automated_readability_index("chars", "words", "sents").alias("ari"),
    ).collect()
    want = {"f": 180 - 20 - 58.5 * 1.6, "w1": 0.1935 * 15 + 0.1672 * 20 + 0.1297 * 30 - 0.0327 * 60 - 0.875, "w4": 0.2744 * 15 + 0.2656 * 20 - 1.693, "lix": 50.0, "ari": 4.71 * 5 + 10 - 21.43}
    assert {k: round(v, 9) for k, v in scores[0].asDict().items()} == {k: round(v, 9) for k, v in want.items()}
    assert all(v is None for v in scores[1])
    with pytest.raises(ValueError):
        readability.wiener_sachtextformel("a", "b", "c", "d", "e", 5)
    with pytest.raises(Exception, match="no reading ease"):
        counts.select(readability.flesch_reading_ease("syll", "words", "sents", F.lit("xx"))).collect()
    assert counts.select(readability.flesch_reading_ease("syll", "words", "sents", F.lit("xx"), strict=False)).first()[0] is None


def test_parsed_articles_and_paragraphs(spark):
    whole = "Utl.: Neues Amt = WIEN (APA) - Der Rat tagt , ja . Seite 3"
    row = articles.parsed(spark.createDataFrame([(whole,)], "text string")).first()
    assert (row.subtitle, row.place, row.agency, row.note, row.body) == ("Neues Amt", "WIEN", "APA", "Seite 3", "Der Rat tagt, ja.") and row.tokens == ["Der", "Rat", "tagt", "ja"]
    strict = articles.parsed(spark.createDataFrame([(whole,)], "text string"), tokens_only=True).first()
    assert "Utl" in strict.tokens and "subtitle" not in strict
    file = '<file><doc id="Dr. Josef Hof" x="sport"><p>Dr. Josef Hof kam heute an</p><p>kurz</p></doc><doc id="2"></doc></file>'
    docs = articles.documents(spark.createDataFrame([("f", file)], "path string, text string"), [("Josef", "Hof", "", "Dr.")])
    assert [(r.meta["id"], r.text) for r in articles.document_texts(docs).collect()] == [("Dr. Josef Hof", "hof kam heute an kurz"), ("2", "")]
    assert [(r.p_ix, r.paragraph) for r in articles.paragraph_rows(docs).collect()] == [(0, "hof kam heute an"), (1, "kurz")]
    assert [r.paragraph for r in articles.paragraphs_with(docs, ["id"]).collect()] == ["Hof kam heute an"]
    assert articles.having_any(docs, ["sport"]).count() == 1 and articles.having_any(docs, ["x", "y"]).count() == 1 and articles.having_any(docs, []).count() == 0
    assert {(r.key, r.value) for r in articles.attribute_rows(docs).collect()} == {("id", "Dr. Josef Hof"), ("x", "sport"), ("id", "2")}

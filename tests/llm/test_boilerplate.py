from corpuswerk.llm import boilerplate


def test_articles_keep_their_words_and_all_their_parts(spark):
    rows, months = [], ["", "April", "Mai", "Juni", "Juli"]

    def sentence(sid, article, wert, words):
        rows.extend((sid, ix, article, "A", wert, word) for ix, word in enumerate(words.split(), 1))

    for a in range(1, 5):
        sentence(10 * a, a, "titel", f"Nr. {a} : Graz")
        sentence(10 * a + 1, a, "inhalt", f"Am {a}. {months[a]} , 12 Uhr")
        sentence(10 * a + 2, a, "inhalt", "2 : 1")
        sentence(10 * a + 3, a, "inhalt", "Lesen Sie mehr !")
    sentence(50, 5, "titel", "Lesen Sie mehr !")
    frame = spark.createDataFrame(rows, "sid bigint, ix int, id_article bigint, docsrc string, wert string, word string").selectExpr("*", "timestamp'2024-01-01' as load_ts")
    out = {r[0]: tuple(r)[1:] for r in boilerplate.without_boilerplate(frame, boilerplate.find_boilerplate(frame)).collect()}
    # "2 : 1" has no letter and is no boilerplate; a title is never boilerplate.
    assert out == {a: (3, 1, f"Nr. {a} : Graz\nAm {a}. {months[a]} , 12 Uhr\n2 : 1") for a in range(1, 5)} | {5: (1, 0, "Lesen Sie mehr !")}


def _rows(spark, sentences):
    """sentences: (sid, article, text, wert, load)."""
    rows = [(sid, ix, a, "A", wert, w, f"2024-01-0{load}") for sid, a, text, wert, load in sentences for ix, w in enumerate(text.split(), 1)]
    return spark.createDataFrame(rows, "sid bigint, ix int, id_article bigint, docsrc string, wert string, word string, at string").selectExpr("*", "timestamp(at) as load_ts", "1 as node")


def test_edges_decide_where_blocks_need_several_lines(spark):
    sentences = []
    for a in range(1, 5):
        sentences += [(100 * a, a, "Alle Rechte vorbehalten", "inhalt", 1), (100 * a + 1, a, "Bitte weitersagen", "inhalt", 1), (100 * a + 2, a, f"Neues {'xyzw'[a - 1]}", "inhalt", 1), (100 * a + 3, a, "Wir danken", "inhalt", 1)]
    sentences += [(500, 5, "Bitte weitersagen", "inhalt", 1)]
    rows = _rows(spark, sentences)
    lone = {r.sid for r in boilerplate.find_boilerplate(rows).found.collect()}
    assert lone == {100 * a + k for a in range(1, 5) for k in (0, 1, 3)} | {500}
    # Of two tied lines and a lone one only the tied stay; where one stands without the other it is no occurrence.
    assert {r.sid for r in boilerplate.find_boilerplate(rows, least_lines=2).found.collect()} == {100 * a + k for a in range(1, 5) for k in (0, 1)}
    assert len({r.block for r in boilerplate.find_boilerplate(rows).blocks.collect()}) == 2
    assert boilerplate.find_boilerplate(rows.limit(0)).found.count() == 0


def test_the_latest_delivery_tells_the_part(spark):
    sentences = [(10 * a, a, "Alle Rechte", "inhalt", 1) for a in range(1, 5)] + [(10, 1, "Alle Rechte", "titel", 2)]
    assert boilerplate.find_boilerplate(_rows(spark, sentences)).found.count() == 0

from corpuswerk.llm import lookalike


def test_characters_beyond_the_first_plane_stay_whole(spark):
    texts = ["x\U0001f44dy", "x\U0001f680y", "x??y", "\U0001d173", "é\U0001f44d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    forms = dict(lookalike.canonical(docs, "doc_id", "text").collect())
    assert forms == dict(enumerate(texts[:4])) | {4: "é\U0001f44d"}
    assert lookalike.look_alikes(docs).count() == 0


def brute(text):
    """The form of a text at once, without Spark."""
    import unicodedata

    if text is None:
        return None
    text = "".join(lookalike.mapping().get(c, c) for c in text.replace("\r\n", "\n"))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text))


def test_forms_equal_those_made_at_once_whatever_the_key(spark):
    import random

    rng = random.Random(6)
    letters = ["a", "e", "u", " ", "\n", "\u0301", "\u0327", "\u00a0", "\u200b", "\uff21", "\u0430", "\ufb01", "ß", "²", "é", "\r\n", "\t", "\u1112", "\u1161", "\U0001d400", "."]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "a\u00a0b", "x" * 200_000 + "\u00a0y"]
    rows = [(None if k % 3 == 0 else k % 7, t, 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, raw int")
    got = lookalike.canonical(docs, "doc_id", "text").collect()
    order = lambda pairs: sorted((-1 if k is None else k, t is None, t or "") for k, t in pairs)
    assert order((r.key, r.form) for r in got) == order((k, brute(t)) for k, t, _ in rows)


def test_classes_and_pairs(spark):
    rows = [(1, "a b"), (2, "a\u00a0b"), (3, "a b"), (4, "A b"), (5, "\u200b"), (6, " "), (7, None), (None, "a\u2009b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in lookalike.look_alikes(docs).collect()) == [(1, 2), (2, 3)]
    classes = {r.doc_id: (r.n_texts, r.n_docs) for r in lookalike.form_classes(docs).collect()}
    assert classes == {1: (3, 4), 2: (3, 4), 3: (3, 4), None: (3, 4), 4: (1, 1)}
    assert lookalike.look_alikes(docs.limit(0)).count() == 0 and lookalike.form_classes(docs.limit(0)).count() == 0

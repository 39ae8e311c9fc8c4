import random
from collections import defaultdict

from corpuswerk.llm.termstats import TermStore

SCHEMA = "sid bigint, ix int, at int, id_article bigint, lemma string, word string, deleted boolean"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("sid", "ix", "timestamp_seconds(at) as load_ts", "id_article", "lemma", "word", "deleted", "1 as bucket", "'x' as term")


def terms(lemma, word):
    own = (lemma or "").lower().strip()
    parts = own.split("|") if own and own != "<unknown>" else [word.lower()] if word is not None else []
    return {p for p in parts if p}


def recount(rows):
    """Counts from all deliveries at once."""
    latest = {}
    for sid, ix, at, article, lemma, word, deleted in rows:
        if sid is None or ix is None:
            continue
        state = (at, deleted, article, lemma, word)
        if (sid, ix) not in latest or at > latest[sid, ix][0]:
            latest[sid, ix] = state
    tokens, articles, every = defaultdict(int), defaultdict(set), set()
    for at, deleted, article, lemma, word in latest.values():
        if deleted or article is None:
            continue
        every.add(article)
        for t in terms(lemma, word):
            tokens[t] += 1
            articles[t].add(article)
    return {t: (n, len(articles[t])) for t, n in tokens.items()}, len(every)


def counts(store):
    return {r.term: (r.n_tokens, r.n_articles) for r in store.counts().collect()}


def test_moved_and_deleted_tokens(spark):
    store = TermStore(spark)
    store.apply(batch(spark, [(1, 1, 1, 10, "x", "X", None), (1, 2, 1, 10, "a|b", "Y", None), (2, 1, 1, 11, "<unknown>", "=Z", None)]))
    assert counts(store) == {"x": (1, 1), "a": (1, 1), "b": (1, 1), "=z": (1, 1)} and store.n_articles == 2
    store.apply(batch(spark, [(1, 1, 2, 11, "x", "X", None)]))
    assert counts(store)["x"] == (1, 1)
    store.apply(batch(spark, [(1, 2, 2, None, None, None, True), (2, 1, 0, 99, "late", "late", None)]))
    assert counts(store) == {"x": (1, 1), "=z": (1, 1)} and store.n_articles == 1
    again = TermStore(spark, store.path)
    assert counts(again) == counts(store) and (again.n_articles, again.version) == (1, 3)
    again.apply(batch(spark, []))
    assert counts(again) == counts(store)
    assert counts(TermStore(spark)) == {}


def test_batches_equal_a_recount(spark):
    rng, rows, store, at = random.Random(9), [], TermStore(spark), 0
    for _ in range(4):
        own = []
        for _ in range(60):
            at += 1
            lemma = rng.choice([None, "", " <unknown>", "Haus", "haus ", "a|b", "b|b|", "c"])
            own.append((rng.choice([1, 2, 3, 4, None]), rng.randint(1, 6), at, rng.choice([1, 2, 3, None]), lemma, rng.choice(["Wort", None, "C"]), rng.random() < 0.15))
        rows += own
        store.apply(batch(spark, own + own[:3]))
        want, n = recount(rows)
        assert counts(store) == want and store.n_articles == n
    marks = {r.term: r.mark for r in store.marked(1, 50).collect()}
    assert all((mark == "rare") == (want[t][1] <= 1) for t, mark in marks.items())

from corpuswerk.llm import queries
from corpuswerk.operators.annotated import mentions


def test_pairs_of_one_sentence_are_counted(spark, tmp_path):
    rows = [(1, 1, "Graz", None, "LOC", "B"), (1, 2, "Wien", None, "LOC", "B"), (2, 1, "Graz", None, "LOC", "B")]
    spark.createDataFrame(rows, "sid bigint, ix int, word string, lemma string, ner string, iob string").selectExpr("*", "timestamp'2024-01-01' as load_ts").write.parquet(f"{tmp_path}/df_fields.parquet")
    pairs = [tuple(r) for r in queries.p7_pairs(spark, str(tmp_path)).select("term_a", "term_b", "n_ab", "n_a", "n_b", "n").collect()]
    assert pairs == [("graz", "wien", 1, 2, 1, 2)]
    assert queries.p7_found(spark, str(tmp_path)).count() == 0


def test_only_the_latest_delivery_of_a_token_counts(spark, tmp_path):
    rows = [(1, 1, "Graz", "LOC", "B", "2024-01-01"), (1, 1, "Linz", "LOC", "B", "2024-01-02"), (1, 2, "Wien", "LOC", "B", "2024-01-01"), (1, 3, "Mai", "MISC", "B", "2024-01-01"), (1, 3, "Mai", None, None, "2024-01-02")]
    frame = spark.createDataFrame(rows, "sid bigint, ix int, word string, ner string, iob string, at string").selectExpr("*", "string(null) as lemma", "timestamp(at) as load_ts")
    frame.write.parquet(f"{tmp_path}/df_fields.parquet")
    assert [tuple(r) for r in queries.p7_pairs(spark, str(tmp_path)).select("term_a", "term_b").collect()] == [("linz", "wien")]
    assert sorted(r.spelling for r in mentions(frame).collect()) == ["Linz", "Wien"]


def test_large_baskets_are_cut_into_blocks_without_losing_a_pair(spark):
    import itertools
    import random
    from collections import Counter

    from corpuswerk.llm import cooccurrence

    rng = random.Random(4)
    baskets = {b: {f"i{rng.randint(0, 40)}" for _ in range(rng.choice([1, 3, 30]))} for b in range(12)}
    rows = [(b, i, 0) for b, items in baskets.items() for i in items] * 2 + [(None, "i1", 0), (1, None, 0)]
    frame = spark.createDataFrame(rows, "basket int, item string, n int")
    want = Counter(p for items in baskets.values() for p in itertools.combinations(sorted(items), 2))
    marginal = Counter(i for items in baskets.values() for i in items)
    for size in (1000, 5, 1):
        got = cooccurrence.pair_counts(frame, "basket", "item", block_items=size).collect()
        assert {(r.term_a, r.term_b): r.n_ab for r in got} == want and len(got) == len(want)
        assert all((r.n_a, r.n_b, r.n) == (marginal[r.term_a], marginal[r.term_b], 12) for r in got)
    assert cooccurrence.pair_counts(frame.limit(0), "basket", "item").count() == 0

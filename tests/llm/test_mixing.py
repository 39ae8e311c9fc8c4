import random

from corpuswerk.llm import mixing


def test_flight_keeps_both_totals_and_landing_the_number():
    rng = random.Random(1)
    for n in (3, 10, 200):
        p, x = [rng.random() for _ in range(n)], [float(rng.randint(1, 400)) for _ in range(n)]
        q = mixing.flight(p, x, random.Random(3))
        assert sum(mixing.EDGE < v < 1 - mixing.EDGE for v in q) <= 2
        assert abs(sum(p) - sum(q)) < 1e-6 and abs(sum(a * b for a, b in zip(p, x)) - sum(a * b for a, b in zip(q, x))) < 1e-3
        r = mixing.land(q, x)
        assert set(r) <= {0.0, 1.0} and abs(sum(r) - sum(p)) < 1
    # Each record is drawn as often as its probability has it.
    p, x, hits = [0.3] * 30, [float(k) for k in range(30)], [0] * 30
    for seed in range(600):
        for i, v in enumerate(mixing.land(mixing.flight(p, x, random.Random(seed)), x)):
            hits[i] += v
    assert all(0.2 < h / 600 < 0.4 for h in hits)


def records(spark, sizes):
    rng = random.Random(5)
    rows = [(None if k == 0 else k, s, rng.randint(50, 400), 1) for s, n in sizes.items() for k in range(n)] + [(1, "unlisted", 9, 1), (2, None, 9, 1), (3, "a", 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int, p int")


def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    own = records(spark, {"a": 300, "b": 120, "c": 6})
    mix = mixing.mix(own, targets)
    shares = {r.source: r for r in mix.shares.collect()}
    assert all(abs(shares[s].actual_share - w) < 0.01 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))) and shares["c"].most_repeats == 3 and shares["none"].tokens == 0
    assert all(r.repeats <= {"a": 2, "b": 3, "c": 3}[r.source] for r in mix.sample.collect())
    # A size asked for isn't held down by the smallest source; what it lacks is reported.
    mix = mixing.mix(own, targets, 40_000)
    shares = {r.source: r for r in mix.shares.collect()}
    assert abs(shares["a"].tokens - 20_000) < 400 and abs(shares["b"].tokens - 12_000) < 400
    assert shares["c"].shortfall > 0 and abs(shares["c"].tokens + shares["c"].shortfall - 8_000) < 1 and shares["a"].shortfall == 0
    assert mixing.mix(own.limit(0), targets).sample.count() == 0 and mixing.mix(own, targets.limit(0)).sample.count() == 0

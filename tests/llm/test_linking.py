import itertools
import random

from corpuswerk.llm import linking, queries


def test_misspelt_names_are_given_their_entry(spark, tmp_path):
    names = ["Gewerkschaft G1urosreul", "Glaftbegr", "Bank Brockos", "BrockosBank", "Sankt Glaftberg", "die-SBST", "Krengosdröx", "Krngosdrox AG", "Partei Schlöxel", "Rathaus", "Brockos Bank", "Ver. Drömm"]
    rows = [(k, ix, word, "ORG", "B" if ix == 1 else "I") for k, name in enumerate(names) for ix, word in enumerate(name.split(), 1)]
    spark.createDataFrame(rows, "sid bigint, ix int, word string, ner string, iob string").selectExpr("*", "timestamp'2024-01-01' as load_ts").write.parquet(f"{tmp_path}/df_fields.parquet")
    entries = [("1", "Gewerkschaft Glurosreul", None), ("2", "Glaftberg", []), ("3", "Brockos Bank", ["SBST"]), ("4", "Krengosdröx AG", None), ("5", "Verein Drömm", None), ("6", "Verband Drönnmer", None)]
    spark.createDataFrame(entries, "pid string, label string, aliases array<string>").write.parquet(f"{tmp_path}/gazetteer.parquet")
    out = {r.sid: r.pid for r in queries.p2_found(spark, str(tmp_path)).collect()}
    assert out == dict(enumerate(["1", "2", "3", "3", "2", "3", "4", "4", "", ""])) | {11: "5"}


def test_longest_matches_win():
    a, b, c = (frozenset({x}) for x in "abc")
    assert linking.longest_matches([(0, 4, a), (2, 9, b), (9, 12, c), (8, 10, a)]) == [(2, 9, b), (9, 12, c)]


def test_embedded_names_and_what_is_left_over():
    index = linking.Index([("1", "Brockos Bank"), ("1", "Brockos"), ("2", "SBST"), ("3", "Groß Rell"), ("3", "Rell"), ("4", "Brockos Werke")])
    found = {x: index.embedded(x) for x in ["die-SBST", "BROCKOSBANK", "Bank Brockos", "Rell Groß", "Bad Rell", "SBST Brockos", "Brocks"]}
    assert found == {"die-SBST": "2", "BROCKOSBANK": "1", "Bank Brockos": "1", "Rell Groß": "3", "Bad Rell": "", "SBST Brockos": "", "Brocks": ""}


def test_edits_against_brute_force():
    def one(text):
        out = {text[:i] + text[i + 1 :] for i in range(len(text))} | {text[:i] + text[i + 1] + text[i] + text[i + 2 :] for i in range(len(text) - 1)}
        return out | {text[:i] + c + text[i + k :] for i in range(len(text) + 1) for k in (0, 1) for c in "ab"}

    rng = random.Random(7)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 4))) for _ in range(12)]
    for x, y in itertools.product(words, words):
        first = one(x)
        d = 0 if x == y else 1 if y in first else 2 if any(y in one(z) for z in first) else 3
        assert linking.edits(x, y, 2) == d


def test_empty_gazetteer_reports_every_mention(spark):
    rows = spark.createDataFrame([(1, 1, "Graz", "LOC", "B"), (1, 2, None, "ORG", "B")], "sid bigint, ix int, word string, ner string, iob string").selectExpr("*", "timestamp'2024-01-01' as load_ts")
    nothing = spark.createDataFrame([], "pid string, label string, aliases array<string>")
    assert sorted(tuple(r) for r in linking.link(rows, nothing).collect()) == [(1, 1, ""), (1, 2, "")]

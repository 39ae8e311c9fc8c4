import itertools

import pytest

from corpuswerk.llm import persons, queries


def test_spellings_of_one_person_are_linked(spark, tmp_path):
    same = ["Josef Türtklonwalder", "Türtklonwalder, J.", "JOSEF TUERTKLONWALDER", "Dr. Josef F. Türtklonwadler", "Sepp Türtklonwalder", "Türtklonwalder Josef"]
    office = ["Redaktionsbüro Türtklonwalder", "Red.-Büro Türtklonwalder"]
    others = ["Leopold Türtklonwalder", "A. Glauckholsam", "Anna Glauckholsam", "Andreas Glauckholsam", ""]
    spark.createDataFrame([(x,) for x in [*same[1:], *office, *others, None]], "autor string").write.parquet(f"{tmp_path}/doc.parquet")
    rows = [(1, 1, "Josef", "PER", "B"), (1, 2, "Türtklonwalder", "PER", "I"), (2, 1, "Josef", "LOC", "B")]
    spark.createDataFrame(rows, "sid bigint, ix int, word string, ner string, iob string").selectExpr("*", "timestamp'2024-01-01' as load_ts").write.parquet(f"{tmp_path}/df_fields.parquet")
    out = {tuple(r) for r in queries.p4_found(spark, str(tmp_path)).collect()}
    assert out == {(a, b) for group in (same, office) for a in group for b in group if a < b}


def test_second_parts_of_double_names_and_best_fitting_initials(spark):
    same = ["Margarete Krängpointner-Oberau", "Margarete Krängpointner Oberau", "Margarete Krängpointner", "M. Krängpointner-Oberau", "Gretl Krängpointner-Oberau"]
    near = ["Krormonhofer, M.", "Maximilian Krormonhofer", "Milan Krorklonhofer"]
    out = {tuple(r) for r in persons.same_names(spark.createDataFrame([(x,) for x in same + near], "spelling string")).collect()}
    assert out == {tuple(sorted(p)) for p in itertools.combinations(same, 2)} | {("Krormonhofer, M.", "Maximilian Krormonhofer")}


def test_undefined_names_and_clashing_columns(spark):
    rows = [(None, 1), ("", 2), ("...", 3), ("Anna Müllnerin" * 3000, 4), ("Anna  Müllner", 5), ("Anna Müllner", 6), ("Anna Müllner", 7)]
    frame = spark.createDataFrame(rows, "spelling string, reading int")
    assert [tuple(r) for r in persons.same_names(frame).collect()] == [("Anna  Müllner", "Anna Müllner")]
    assert persons.same_names(frame.limit(0)).count() == 0


def test_bands_find_what_comparing_all_pairs_finds():
    surnames = ["huber", "hubner", "gruber", "steinbacher", "steinbahcer", "steinbchaer", "maierhofer", "maierhfoer", "mairhofer"]
    names = [(False, (s,), g) for s in surnames for g in ("anna", "ana", "josef", "joesf", "j")]
    similar = {(a, b) for a, b in itertools.combinations(names, 2) if persons.monge_elkan(a, b) >= persons.SIMILAR}
    keys = {n: set(persons.band_keys("".join(n[1]), n[2]).tolist()) for n in names}
    met = {(a, b) for a, b in similar if keys[a] & keys[b]}
    assert len(met) >= 0.97 * len(similar) and len(similar) > 20
    assert persons.meeting(1 / 3) > 0.99 and persons.meeting(0.1) < 0.2


@pytest.mark.parametrize("name, want", [("Dr. Josef F. Hobermann", (False, ("hobermann",), "josef")), ("HOBERMANN, Sepp", (False, ("hobermann",), "josef")), ("Red.-Büro Hobermann", (True, ("hobermann",), "")), ("Hobermann Redaktionsbüro", (True, ("hobermann",), "")), ("J.Hobermann", (False, ("hobermann",), "j")), ("1 2", None)])
def test_reading(name, want):
    assert persons.read(name) == want

from corpuswerk.operators.rowcheck import COLUMNS, Rule, check_rows

GOOD = ["Haus", "haus", "1", "NOUN", "NN", "", "O", "1.5", "sb", "2", "", "Haus", "N.Reg", "NN", "Haus-n", "tt"]


def row(**changes):
    cells = list(GOOD)
    for name, value in changes.items():
        cells[COLUMNS.index(name)] = value
    return "\t".join(cells)


def test_reasons_and_typed_rows(spark):
    lines = [
        row(), row(ixDEP=""), row(ixDEP="2147483648"), row(ixDEP="0000000000002"), row(ixNP="1,5"), row(ner="per"), "a\tb", row(word='"a'), row(word='"a"b'), row(word='a"b'), row(word='"a""b\tc"'), '<doc id="x">', '<doc id="x>', "  ", "", None, row(ixNP="x", ner="y"),
        '"x"y\tz', "\t".join(GOOD) + "\t" + "x" * 200_000,
    ]
    frame = spark.createDataFrame([(k, line, "clash") for k, line in enumerate(lines)], "line_id bigint, raw_line string, cell string")
    out = check_rows(frame)
    assert {(r.line_id, r.reason) for r in out.failing.collect()} == {(1, "ixdep"), (2, "ixdep"), (4, "ixnp"), (5, "ner"), (6, "columns"), (7, "quoting"), (8, "quoting"), (9, "quoting"), (12, "quoting"), (16, "ixnp"), (17, "quoting"), (18, "columns")}
    valid = {r.line_id: r for r in out.valid.collect()}
    assert sorted(valid) == [0, 3, 10] and valid[3].ixDEP == 2 and valid[0].ixNP == 1.5 and valid[10].word == 'a"b\tc'


def test_repeated_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(1, row()), (1, row(ner="x")), (1, row())], "line_id bigint, raw_line string")
    out = check_rows(frame)
    assert [r.reason for r in out.failing.collect()] == ["ner"] and out.valid.count() == 2
    out = check_rows(frame.limit(0))
    assert out.failing.count() == 0 and out.valid.count() == 0


def test_other_columns_and_rules(spark):
    frame = spark.createDataFrame([(1, "a\t3"), (2, "b\tx"), (3, "c"), (4, "\t5"), (5, "d\t9999999999")], "id bigint, row string")
    out = check_rows(frame, "id", "row", ["name", "n"], [Rule("name", "noname", r"\S"), Rule("n", "number", r"\A[0-9]+\z", True)], {"n": "int"})
    assert {(r.line_id, r.reason) for r in out.failing.collect()} == {(2, "number"), (3, "columns"), (4, "noname"), (5, "number")}
    assert [tuple(r) for r in out.valid.collect()] == [(1, "a", 3)]

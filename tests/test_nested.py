import json

import pytest

from corpuswerk.operators import nested


def frame(spark, *payloads, ids=None):
    rows = [(k if ids is None else ids[k], "x", p) for k, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "rec_id bigint, pre string, payload string")


def test_every_level_links_to_its_parents(spark):
    tok = {"word": "a", "ix": "1", "ixDEP": 0.0, "tags": {"uds": "NOUN", "np": {"ixNP": "2"}}, "cand": {"pid": "P", "certain": {"cap": True}}}
    record = {"doc": {"id": "d", "id_article": 7, "x": {"y": [1, None, "z"]}}, "field": [None, {"wert": "inhalt", "s": [{"n": 1}, 5], "p": [{"q": 1}, {"s": {"n": 2, "tok": [tok, None, tok]}}]}]}
    tables = {k: [r.asDict() for r in t.orderBy("pre").collect()] for k, t in nested.node_tables(frame(spark, json.dumps(record))).items()}
    assert {k: len(v) for k, v in tables.items()} == {"doc": 1, "field": 1, "s": 2, "p": 2, "tok": 2, "cand": 2}
    assert tables["doc"][0]["rest"] == {"doc.x.y[0]": "1", "doc.x.y[2]": "z"} and tables["field"][0]["id_article"] == 7
    assert tables["p"][0]["rest"] == {"q": "1"} and tables["field"][0]["rest"] == {"s[1]": "5"}
    assert [(s["s_ix"], s["p_ix"], s["n"]) for s in tables["s"]] == [(0, None, 1), (1, 1, 2)]
    t = tables["tok"][1]
    assert (t["field_ix"], t["s_ix"], t["tok_ix"], t["ix"], t["ixDEP"], t["ixNP"], t["uds"]) == (0, 1, 1, 1, 0, 2.0, "NOUN")
    c = tables["cand"][0]
    assert (c["pid"], c["cap"], c["resolved"], c["tok_pre"]) == ("P", True, None, tables["tok"][0]["pre"])
    for child, parent in (("tok", "s"), ("cand", "tok")):
        for row in tables[child]:
            (own,) = [p for p in tables[parent] if p["pre"] == row[f"{parent}_pre"]]
            assert own["pre"] < row["pre"] and own["post"] > row["post"]


def test_bad_values_end_no_job(spark):
    deep = '{"doc":{"id":"deep","z":' + "[" * 20000 + "1" + "]" * 20000 + '},"field":{"wert":"titel"}}'
    payloads = ['{"doc":{"id":"\\ud800","id_article":1e300}}', '{"doc":{"id_article":"100000000000000000000"}}', '{"doc":{"id_article":true}}', deep, None, "[1]", "{", "", '{"field":[]}']
    data = frame(spark, *payloads)
    tables = nested.node_tables(data)
    docs = {r.rec_id: r for r in tables["doc"].collect()}
    assert sorted(docs) == [0, 1, 2, 3, 8] and docs[0].id == "�" and all(docs[k].id_article is None for k in (0, 1, 2)) and docs[3].id == "deep"
    assert [r.wert for r in tables["field"].collect()] == ["titel"]
    assert {(r.rec_id, r.reason) for r in nested.rejected(data).collect()} == {(4, "null"), (5, "json"), (6, "json"), (7, "json")}


def test_records_of_one_id_stay_apart(spark):
    a, b = '{"doc":{"id":"a"},"field":{"s":{"n":1}}}', '{"doc":{"id":"b"},"field":{"s":{"n":2}}}'
    tables = nested.node_tables(frame(spark, a, b, b, ids=[1, 1, 1]))
    parts = {r.id: r.rec_part for r in tables["doc"].collect()}
    assert len(set(parts.values())) == 2 and {(r.rec_part, r.n) for r in tables["s"].collect()} == {(parts["a"], 1), (parts["b"], 2)}
    assert nested.places(nested.labelled_nodes(frame(spark, a).limit(0), labels_only=True)).count() == 0


def test_other_records_by_another_tree(spark):
    item = nested.Level("item", "items", {"sku": ("string", "sku"), "n": ("bigint", "amount.n")})
    order = nested.Level("order", "", {"nr": ("string", "nr")}, (nested.Level("parcel", "parcels", {}, (item,)), item))
    tables = nested.node_tables(frame(spark, '{"nr":"o","parcels":[{"items":[{"sku":"a","amount":{"n":2}}]}],"items":{"sku":"b","x":1}}'), root=order)
    assert {(r.sku, r.n, r.parcel_ix, r.item_ix) for r in tables["item"].collect()} == {("a", 2, 0, 0), ("b", None, None, 0)}


@pytest.mark.parametrize("text", ['{"a":[1,2,{"b":null}],"c":"x\\u00e9"}', "[]", "{}", ' {"a" : [ ] , "b":{} } ', '[1,[2,[3]],{"q":[{}]}]', "3", '{"a":1', '{"a" 1}', "[1 2]", "{} {}", "", "{1:2}", "[1,]", '{"a":1,}'])
def test_parsing_with_a_stack_equals_json(text):
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            nested._parse_deep(text)
    else:
        assert nested._parse_deep(text) == want

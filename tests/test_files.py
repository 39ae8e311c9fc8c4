"""Readers over small hand-made files."""

from corpuswerk.sources import records, verticals
from corpuswerk.streaming import files

TOKEN = "{0}\t{1}\t{2}\tNOUN\tNN\t\tO\t1.5\tsb\t0\t\t{0}\tN\tNN\t{0}-n\ttt"
FILE = f"""<file>
<doc id="A_20150102" datum="2015-01-02" docsrc="A" tokens="7" >
<field name="titel">
<s>
{TOKEN.format("Haus", "haus", 1)}
<g/>
{TOKEN.format("<", "<", 2)}

</s>
stray
</field>
<field name="inhalt">
<p>
<s>
{TOKEN.format("Amt", "amt", "x")}
too\tshort
</s>
</p>
</field>
</doc>
<doc datum="2015-01-03">
<field name="stichwort">
<s>
{TOKEN.format("Eins", "eins", 1)}
</s>
<s>
{TOKEN.format("Zwei", "zwei", 1)}
</s>
</field>
beyond
</doc>
</file>
"""


def test_vertical_file(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "one.vert").write_text(FILE)
    (tmp_path / "in" / "empty.vert").write_text("")
    docs = verticals.documents(verticals.read_files(spark, f"{tmp_path}/in"))
    heads = [(r.id_article, r.id, r.docsrc, r.autor) for r in verticals.headers(docs).orderBy("id_article").collect()]
    assert heads == [(0, "A_20150102", "A", None), (1, None, None, None)]
    rows = verticals.tokens(docs).orderBy("doc_ix", "sid", "w_ix").collect()
    assert [(r.word, r.ix, r.field, r.space_after, r.ixNP) for r in rows] == [("Amt", None, "inhalt", True, 1.5), ("Haus", 1, "titel", False, 1.5), ("<", 2, "titel", True, 1.5), ("Eins", 1, "stichwort", True, 1.5), ("Zwei", 1, "stichwort", True, 1.5)]
    assert len({r.sid for r in rows}) == 4  # sentences of two documents of a file never share an id
    assert [(r.n_columns, r.line) for r in verticals.malformed(docs).collect()] == [(2, "too\tshort")]
    assert {(r.rule, r.line) for r in verticals.outside(docs).collect()} == {("outside of sentences", "stray"), ("outside of fields", "beyond")}
    articles = {r.doc_id.split("#")[-1]: (r.titel, r.stichwort, r.text) for r in verticals.article_text(verticals.tokens(docs)).collect()}
    assert articles == {"A_20150102": ("Haus <", "", "Amt"), "1": ("", "Eins, Zwei", "")}


def test_enriched_rows_with_a_missing_column(spark):
    full = "Graz\tN\tNE\tGraz-n\t1\tPROPN\tNE\tLOC\tB\t5\tLOC\tB\t0\tsb\t2"
    short = "geht\tV\tVV\tgehen-v\t2\tVERB\tVV\t\tO\t6\t0\t\tROOT\t2"
    text = f'<doc id="x">\n<field name="inhalt">\n<s>\n{full}\n{short}\n</s>\n</field>\n</doc>'
    rows = verticals.enriched_tokens(verticals.documents(spark.createDataFrame([("p", text)], "path string, text string"))).orderBy("w_ix").collect()
    assert [(r.word, r.i, r.ent_type, r.ent_iob, r.noun_chunk, r.dep, r["head"]) for r in rows] == [("Graz", 1, "LOC", "B", "0", "sb", 2), ("geht", 2, "0", "", "", "ROOT", 2)]


def test_lexica_and_records(spark, tmp_path):
    (tmp_path / "emo").mkdir()
    (tmp_path / "emo" / "FREUDE.de.txt").write_text("Glück  froh\nfroh")
    (tmp_path / "emo" / "WUT.txt").write_text("Zorn froh")
    assert {(r.word, r.kind) for r in records.emotion_words(spark, f"{tmp_path}/emo").collect()} == {("glück", "FREUDE"), ("froh", "FREUDE"), ("zorn", "WUT"), ("froh", "WUT")}
    (tmp_path / "pos.txt").write_text("Gut|ADJX\t0.37\tgute,guter\nToll|ADJX 0.5\n\nGut|NN 0.1\n")
    lexicon = records.polarity_words(records.numbered_lines(spark, f"{tmp_path}/pos.txt"), "POS")
    assert {(r.word, r.value) for r in lexicon.collect()} == {("gut", 0.1), ("gute", 0.37), ("guter", 0.37), ("toll", 0.5)}
    assert {r.word for r in records.polarity_words(records.numbered_lines(spark, f"{tmp_path}/pos.txt"), "POS", ["oll"]).collect()} == {"toll"}
    assert {(r.word, r.value) for r in records.amended(lexicon, {"gut": 0.9}, ["toll"], "POS").collect()} == {("gut", 0.9), ("gute", 0.37), ("guter", 0.37)}
    (tmp_path / "stop.json").write_text('["Oder", "xyz"]')
    stop = {r.word for r in records.stop_words(spark, ["Mehr"], f"{tmp_path}/stop.json").collect()}
    assert {"mehr", "oder", "xyz", "und"} <= stop
    (tmp_path / "svo_triplets_A").write_text("loben;['a', 'b'];['c']\nsehen;x;['y']\nbad")
    assert {(r.source, r.verb, tuple(r.subj), tuple(r.obj)) for r in records.read_triples(spark, str(tmp_path), ["A"]).collect()} == {("A", "loben", ("a", "b"), ("c",)), ("A", "sehen", ("x",), ("y",))}
    (tmp_path / "q.json").write_text('{"results": {"bindings": [{"s": {"value": "Q1"}, "l": {"value": "x"}}, {"s": {"value": "Q2"}}]}}')
    assert {(r.s, r.l) for r in records.bindings(spark, f"{tmp_path}/q.json").collect()} == {("Q1", "x"), ("Q2", None)}
    (tmp_path / "v.json").write_text('{"items": [{"views": 3}, {"views": 4}]}')
    assert records.page_views(spark, f"{tmp_path}/v.json").first().views == [3, 4]
    assert {r["size"] for r in records.inventory(spark, f"{tmp_path}/emo").collect()} == {17, 9}


def test_classes_end_in_cycles(spark):
    rows = [("b", "P279", "a"), ("c", "P279", "b"), ("a", "P279", "c"), ("x", "P31", "c"), ("y", "P31", "q"), ("x", "label", "X")]
    statements = spark.createDataFrame(rows, "s string, p string, o string")
    assert {r["class"] for r in records.subclasses(statements, ["a"]).collect()} == {"a", "b", "c"}
    assert [(r.s, r.type) for r in records.typed_entities(statements, {"T": ["a"]}).collect()] == [("x", "T")]
    assert [(r.s, r.label, r.classes) for r in records.entity_records(statements, "label", {"classes": "P31"}).collect()] == [("x", "X", ["c"])]


def test_batches_of_files_are_there_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.vert").write_text(FILE.replace("A_20150102", f"A_{k}"))
    for _ in range(2):  # the second run finds nothing new
        files.ingest(files.file_stream(spark, f"{tmp_path}/in", 2), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 15


def test_windows(spark):
    rows = [("2024-01-01 00:10:00", "a", 1), ("2024-01-01 00:50:00", "a", 1), ("2024-01-01 01:05:00", "a", 2), (None, "a", 1), ("2024-01-01 00:10:00", None, 1)]
    events = spark.createDataFrame(rows, "t string, kind string, user int").selectExpr("timestamp(t) as t", "kind", "user")
    assert sorted((str(r.start), r.n) for r in files.windowed_counts(events, "t", "kind").collect()) == [("2024-01-01 00:00:00", 2), ("2024-01-01 01:00:00", 1)]
    assert len(files.windowed_counts(events, "t", "kind", "1 hour", "30 minutes").collect()) == 4
    assert sorted(r.n for r in files.session_counts(events, "t", "user", "45 minutes").collect()) == [1, 3]

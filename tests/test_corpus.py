"""Operators over a few hand-made sentences, and state machines against small independent versions."""

import random

import pytest

from corpuswerk.operators import gazetteer, graph, models, network, svo, wordclass
from corpuswerk.operators.gazetteer import Span, settle
from corpuswerk.sinks import graph_files, graph_tables

SCHEMA = "sid bigint, ix int, id_article bigint, wert string, word string, lemma string, pos string, posTT string, posUDS string, posTI string, dep string, ner string, iob string, ixNP double, ixDEP int, docsrc string"


def sentence(sid, rows, article=1):
    """rows: (word, lemma, class, dep, head, ner, iob, np)."""
    tags = {"N": ("N.Reg", "NN", "NOUN", "NN"), "V": ("VFIN", "VVFIN", "VERB", "VVFIN"), "A": ("ADJA", "ADJA", "ADJ", "ADJA"), "X": ("SYM", "$.", "PUNCT", "$.")}
    return [(sid, k, article, "inhalt", w, lem, *tags[c], dep, ner, iob, np, head, "Q") for k, (w, lem, c, dep, head, ner, iob, np) in enumerate(rows, 1)]


def tokens(spark, *rows):
    return spark.createDataFrame([r for part in rows for r in part], SCHEMA)


def test_spans_drop_orphans_and_reach_the_end(spark):
    words = [("x", "I"), ("Bad", "B"), ("Ort", "I"), ("y", "O"), ("z", "I"), ("A", "B"), ("B", "B"), ("C", "I")]
    t = tokens(spark, sentence(1, [(w, w, "N", "sb", 0, "LOC" if i != "O" else None, i, None) for w, i in words]))
    assert sorted((r.ix, r.etype, r.entity) for r in wordclass.entity_spans(t).collect()) == [(2, "LOC", "Bad Ort"), (6, "LOC", "A"), (7, "LOC", "B C")]
    assert {r.entity: r.LOC for r in wordclass.span_counts(t).collect()} == {"Bad Ort": 1, "A": 1, "B C": 1}


def test_votes_and_first_best_class(spark):
    rows = [(1, 1, None, None, None, None), (1, 2, "VFIN", "VVFIN", "NOUN", "x"), (1, 3, "PTKNEG", "PTKNEG", "PART", "PTKNEG"), (1, 4, "ADV", "ADJD", None, None)]
    t = spark.createDataFrame(rows, "sid bigint, ix int, pos string, posTT string, posUDS string, posTI string")
    got = {r.ix: (r.c, r.s[0]) for r in t.select("ix", wordclass.best_class(wordclass.class_scores()).alias("c"), wordclass.class_scores().alias("s")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "NOUN", 2: "NOUN", 3: "PTKNEG", 4: "ADJ"} and got[2][1] == 3.0


def test_chunks_with_and_without_the_last_one(spark):
    t = tokens(spark, sentence(1, [("Das", "das", "A", "nk", 2, None, "O", 1.0), ("Haus", "haus", "N", "sb", 3, None, "O", 1.0), ("steht", "stehen", "V", "ROOT", 0, None, "O", None), ("Am", "am", "N", "mo", 3, None, "O", 1.0), ("See", "see", "N", "nk", 4, None, "O", 1.0)]))
    assert [(r.first_ix, r.words) for r in wordclass.noun_chunks(t).orderBy("first_ix").collect()] == [(1, "das haus"), (4, "am see")]
    assert [r.words for r in wordclass.noun_chunks(t, keep_last=False).collect()] == ["das haus"]


def test_vocabulary_counts_all_readings_and_numbers_by_first_appearance(spark):
    t = tokens(spark, sentence(2, [("kürzt", "kürzen|schließen", "V", "ROOT", 0, None, "O", None)]), sentence(1, [("Graz", "Graz", "N", "sb", 2, "LOC", "B", None), ("x", "<unknown>", "N", "oa", 1, None, "O", None), ("y", "Kürzen", "N", "oa", 1, None, "O", None)]))
    assert sorted((r.ent_id, r.entity, r.freq) for r in wordclass.entity_vocabulary(t).collect()) == [(0, "Graz", 1), (1, "x", 1), (2, "kürzen", 2), (3, "schließen", 1)]


def test_triples_follow_chains_of_conjuncts(spark):
    rows = [("Alt", "amt", "N", "sb", 3, None, "O", None), ("Bund", "bund", "N", "cj", 1, None, "O", None), ("lobt", "loben", "V", "ROOT", 0, None, "O", None), ("Cent", "cent", "N", "oa", 3, None, "O", None), ("Dorf", "dorf", "N", "cj", 4, None, "O", None), ("Erde", "erde", "N", "cj", 5, None, "O", None)]
    rows += [("Last", "last", "N", "cj", 9, None, "O", None), ("x", "x", "X", "--", 0, None, "O", None), ("Ring", "ring", "N", "nk", 8, None, "O", None)]
    found = svo.triples(wordclass.classified(tokens(spark, sentence(1, rows))))
    assert sorted((r.subj, r.verb, r.obj) for r in found.collect()) == sorted((s, "loben", o) for s in ("amt", "bund") for o in ("cent", "dorf", "erde"))


def test_lookups_name_the_other_side(spark):
    t = spark.createDataFrame([("v", ["a"], ["b", "c"]), ("w", ["a", "b"], ["b"]), ("u", ["d"], ["a"]), ("x", [], ["a"]), ("y", None, None)], "verb string, subj array<string>, obj array<string>")
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    out = sorted((r.word, r.other or "", r.whole or "") for r in svo.lookup(t, words).collect())
    assert out == [("a", "", ""), ("a", "b", ""), ("a", "b", ""), ("a", "d", ""), ("b", "", "w;a,b;b"), ("b", "a", "")]
    assert sorted(r.other or "" for r in svo.partners(t, "a").collect()) == ["", "b", "b", "d"]
    lexicon = spark.createDataFrame([("v", "POS", 1.0), ("v", "NEG", -1.0), ("u", "NEG", -1.0)], "word string, kind string, value double")
    assert {r.verb: r.polarity for r in svo.with_polarity(t, lexicon).collect()} == {"v": "POS", "u": "NEG", "w": "NEUT", "x": "NEUT", "y": "NEUT"}
    assert {r.verb: r.n for r in svo.neutral_verbs(t, words, lexicon).collect()} == {"w": 2, "x": 1}


def breadth_first(pairs, start, depth):
    """Nodes by level and word; a node's neighbours are those not visited before it."""
    visited, out, level = set(), {}, list(dict.fromkeys(start))
    ranks = {w: (0, k, w) for k, w in enumerate(level)}
    for d in range(depth):
        fresh = set()
        for node in level:
            for s, o in pairs:
                if node in (s, o):
                    other = s if o == node else o
                    if other not in ranks or ranks[other] > ranks[node]:
                        out[node, other] = out.get((node, other), 0) + 1
                        fresh.add(other)
        level = sorted(w for w in fresh if w not in ranks)
        ranks |= {w: (d + 1, 0, w) for w in level}
        visited |= set(level)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbourhood_against_a_small_version(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice("abcdefghij"), rng.choice("abcdefghij")) for _ in range(14)]
    frame = spark.createDataFrame(pairs, "subj string, obj string")
    got = {(r.node, r.neighbour): r.n for r in svo.neighbourhood(frame, ["b", "a"], 3).collect()}
    assert got == breadth_first(pairs, ["b", "a"], 3)


def test_pairs_never_use_one_mention_twice_and_keep_thresholds(spark):
    rows = [(1, 1, 1, "a", "NOUN"), (1, 1, 2, "a", "NOUN"), (1, 1, 3, "b", "NOUN"), (1, 1, 4, "b", "PER"), (2, 1, 1, "a", "NOUN"), (2, 1, 2, "b", "NOUN"), (3, 2, 1, "b", "NOUN")]
    m = spark.createDataFrame([(s, d, i, w, e, w == "z", None) for s, d, i, w, e in rows], "sid bigint, doc_id bigint, ix int, word string, etype string, is_stop boolean, wid string")
    docs = spark.createDataFrame([(1, 20200101, "Q", "politik, inland"), (2, 20200102, "R", None)], "doc_id bigint, date_int int, docsrc string, section string")
    net = lambda **k: {(r.n1, r.n2): r.weight for r in network.sentence_network(m, docs, network.Network(**{"freq": 0, **k})).collect()}
    assert net() == {("a", "b"): 3} and net(freq=3) == {} and net(freq=2) == {("a", "b"): 3}
    assert net(pos1=("NOUN",), pos2=("NOUN", "PER")) == {("a", "a"): 2, ("a", "b"): 5, ("b", "a"): 3, ("b", "b"): 1}
    assert net(documents=network.Documents(date=20200102)) == {} and net(documents=network.Documents(start=20200101, end=20200102, sources=["Q"], sections=["inland", "x"])) == {("a", "b"): 3}
    assert net(center="b") == {} and net(center="a") == {("a", "b"): 3}
    para = network.paragraph_network(m, docs, network.Network(freq=0), ["doc_id"])
    assert {(r.n1, r.n2): r.weight for r in para.collect()} == {("a", "b"): 3}


def incumbent(spans):
    """The rules of settle once more, step by step over plain lists."""
    queues = {k: sorted([s for s in spans if s.kind == k], key=lambda s: s.start) for k in gazetteer.KINDS}
    out = []
    while any(queues.values()):
        best, again = None, True
        while again:
            again = False
            for k in gazetteer.KINDS:
                if not queues[k] or queues[k][0] is best:
                    continue
                h = queues[k][0]
                if best is None:
                    best = h
                elif h.end < best.start and h.start < best.start:
                    best = h
                elif h.start <= best.start:
                    if h.sure and (not best.sure or h.end - h.start > best.end - best.start):
                        queues[best.kind].remove(best)
                        best, again = h, True
                    else:
                        queues[k].remove(h)
                elif h.start <= best.end:
                    if h.sure and not best.sure:
                        queues[best.kind].remove(best)
                        best, again = h, True
                    else:
                        queues[k].remove(h)
        queues[best.kind].remove(best)
        out.append(best)
    return out


def test_settled_spans_against_a_small_version(spark):
    rng = random.Random(5)
    for n in range(300):
        spans = []
        for kind in gazetteer.KINDS:
            at = 0
            for k in range(rng.randint(0, 3)):
                start = at + rng.randint(0, 3)
                at = start + rng.randint(1, 3)
                spans.append(Span(kind, start, at - 1, rng.random() < 0.5, f"{kind}{k}{n}"))
        assert settle(spans) == incumbent(spans)


def test_persons_are_resolved_by_their_document(spark):
    def named(sid, article, words):
        return [(sid, k, article, w) for k, w in enumerate(words.split(), 1)]

    t = spark.createDataFrame(named(1, 1, "berg kommt") + named(2, 1, "Anna Berg lobt") + named(3, 1, "Bergs Amt") + named(4, 2, "Berg sagt"), "sid bigint, ix int, id_article bigint, word string")
    people = spark.createDataFrame([("p1", "Anna Berg", None, None, 3), ("p2", "Emil Berg", None, None, 9)], "pid string, name string, firstnames array<string>, lastnames array<string>, views bigint")
    out = {r.sid: (r.start, r.plen, r.pid, r.resolved, r.cap) for r in gazetteer.link_persons(t, people).collect()}
    assert out == {1: (1, 1, "p1", True, False), 2: (1, 2, "p1", True, True), 3: (1, 1, "p1", True, True), 4: (1, 1, "p2", False, True)}
    out = gazetteer.link_persons(t, people, people.filter("pid = 'p2'").select("pid"))
    assert {r.sid: r.resolved for r in out.collect()}[4] is False


def test_overlapping_starts_of_names_are_all_found(spark):
    t = spark.createDataFrame([(1, k, w) for k, w in enumerate("bad bad Ort am See FPX".split(), 1)], "sid bigint, ix int, word string")
    names = spark.createDataFrame([("a", "Bad Ort"), ("b", "Bad Ort am See"), ("c", "FPX"), ("d", "fpx"), ("e", "See FP")], "pid string, name string")
    found = {(r.start, r.plen, r.pid) for r in gazetteer.runs(t, gazetteer.lookup_table(names)).collect()}
    assert found == {(2, 2, "a"), (2, 4, "b"), (6, 1, "c")}


def test_first_names_of_longer_names_are_kept(spark):
    people = spark.createDataFrame([("p", "Max Otto Berg Hof", ["Max", "Otto"], []), ("q", "Li de Boor", [], ["de"]), ("r", "Uwe X Tal", [], [])], "pid string, name string, firstnames array<string>, lastnames array<string>")
    firsts, lasts = gazetteer.person_names(people)
    assert {(r.pid, r.name) for r in firsts.collect()} == {("p", "Max"), ("p", "Otto"), ("p", "Max Otto"), ("p", "M."), ("q", "Li"), ("q", "L."), ("r", "Uwe X"), ("r", "U.")}
    assert {(r.pid, r.name) for r in lasts.collect()} == {("p", "Berg Hof"), ("p", "Berg Hofs"), ("q", "de"), ("q", "des"), ("q", "de Boor"), ("q", "de Boors"), ("r", "Tal"), ("r", "Tals")}


def test_components_and_communities(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(45)] + [("x", "x"), (None, "y")]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight int")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    nodes = spark.createDataFrame([(x,) for x in parent], "node string")
    got = {r.node: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert got == {x: find(x) for x in parent}
    sizes = {r.node: r["size"] for r in graph.large_components(nodes, edges, 2).collect()}
    count = {x: sum(find(y) == find(x) for y in parent) for x in parent}
    assert sizes == {x: n for x, n in count.items() if n > 2}
    two = spark.createDataFrame([("a", "b", 5), ("b", "c", 5), ("a", "c", 5), ("c", "d", 1), ("d", "e", 5), ("e", "f", 5), ("d", "f", 5)], "src string, dst string, weight int")
    labels = {r.node: r.community for r in graph.communities(two).collect()}
    assert labels["a"] == labels["b"] == labels["c"] != labels["d"] == labels["e"] == labels["f"]


def test_graph_tables(spark, tmp_path):
    svo_rows = spark.createDataFrame([(1, "a", "v", "b"), (1, "a", "v", "b"), (2, "b", "v", "a")], "sid bigint, subj string, verb string, obj string")
    nodes = graph_tables.svo_nodes(svo_rows)
    stop = spark.createDataFrame([("a",)], "word string")
    edges = {(r.role, r.nvn_id, r.is_stop) for r in graph_tables.svo_edges(nodes, stop).collect()}
    # Each role goes by its own word.
    assert edges == {("subj", "a-b-v-1", True), ("verb", "a-b-v-1", False), ("obj", "a-b-v-1", False), ("subj", "b-a-v-2", False), ("verb", "b-a-v-2", False), ("obj", "b-a-v-2", True)}
    graph_tables.write_graph({"svo": graph_tables.svo_edges(nodes, stop)}, f"{tmp_path}/graph")
    assert spark.read.csv(f"{tmp_path}/graph/svo").count() == 6 and (tmp_path / "graph/svo/is_stop=true/role=subj").exists()
    with pytest.raises(Exception, match="(?i)exists"):
        graph_tables.write_csv(nodes, f"{tmp_path}/graph/svo")


def test_graph_files_are_well_formed(spark, tmp_path):
    import xml.etree.ElementTree as ET

    edges = spark.createDataFrame([("a&b", "c<d", 2, "x"), ("c<d", 'e"f', 1, "y"), ("q", "r", 1, "x")], "src string, dst string, weight int, kind string")
    for name, lines in (("gexf", graph_files.gexf_lines(edges, {"x": (1, 2, 3)}, "kind", 2)), ("graphml", graph_files.graphml_lines(edges))):
        graph_files.write_lines(lines, f"{tmp_path}/{name}")
        whole = "\n".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        root = ET.fromstring(whole)
        kinds = [e.tag.split("}")[1] for e in root.iter()]
        assert kinds.count("edge") == (2 if name == "gexf" else 3) and kinds.count("node") == (3 if name == "gexf" else 5)
        assert kinds.count("color") == (1 if name == "gexf" else 0)
    assert sorted(r.line for r in graph_files.edge_csv(edges).collect())[0] == "a&b;c<d;2"
    with pytest.raises(Exception, match="overwrite"):
        spark.range(1).select(graph_files.target_path(__import__("pyspark").sql.functions.lit("/a/b"), "x", "y")).collect()


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", [0.0, 2.0]), ("e", [2.0, 2.1]), ("z", [0.0, 0.0])], "word string, vector array<double>")
    assert [r.word for r in models.most_similar(v, v.filter("word = 'b'"), 2, ["b"]).collect()] == ["d", "e"]
    # b + c - a = (0, 2): d is nearest and left out.
    assert [r.word for r in models.analogies(v, ["a", "b", "c"], 2).collect()] == ["e"]
    assert models.analogies(v, ["a", "b", "c"], 1, drop_first=False).first().word == "d"
    grams = {r.word: r.vector for r in models.gram_vectors(spark.createDataFrame([("haus",), ("hauses",), ("xyz",)], "word string")).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(grams[a], grams[b]))
    assert abs(dot("haus", "haus") - 1) < 1e-9 and dot("haus", "hauses") > dot("haus", "xyz")

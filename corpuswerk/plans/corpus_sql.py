"""The queries over the annotated corpus as SQL, for comparison."""

from __future__ import annotations

from corpuswerk.functions.readability import FLESCH, WIENER
from corpuswerk.operators.wordclass import CLASSES, IN_ENTITY, TAGS, VOTES
from corpuswerk.plans.corpus import EMOTIONS, POLARITY, STOP
from corpuswerk.plans.corpus_queries import CENTER


def _text(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows: list[tuple], name: str, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows) + ")"


def _score(name: str) -> str:
    begins, tags, universals, parsers = TAGS[name]
    rf = " AND ".join(f"starts_with(pos, {_text(b[1:])})" if b[0] == "^" else f"contains(pos, {_text(b)})" for b in begins)
    tt = " OR ".join(f"starts_with(posTT, {_text(t[:-1])})" if t[-1] == "*" else f"posTT = {_text(t)}" for t in tags)
    parts = [f"{VOTES[0]} * coalesce(({rf})::int, 0)", f"{VOTES[1]} * coalesce(({tt})::int, 0)"]
    for column, values in (("posUDS", universals), ("posTI", parsers)):
        if values:
            parts.append(f"{VOTES[2]} * coalesce(({column} IN ({', '.join(map(_text, values))}))::int, 0)")
    return "(" + " + ".join(parts) + ")::double"


GOOD = r"(length(word) > 1 AND regexp_matches(word, '[\p{L}\p{N}.\-]$') AND regexp_matches(left(replace(word, '-', ''), greatest(length(replace(word, '-', '')) - 1, 0)), '^[\p{L}\p{N}]+$'))"
LEMMAS = "string_split(CASE WHEN trim(lower(lemma)) IS NULL OR trim(lower(lemma)) IN ('', '<unknown>') THEN lower(coalesce(word, '')) ELSE trim(lower(lemma)) END, '|')"
CLASS = f"CASE WHEN span IS NOT NULL THEN 'NOUN' ELSE [{', '.join(map(_text, CLASSES))}][list_position(scores, list_max(scores))] END"
assert IN_ENTITY > 0

PARTS = [
    "tok AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sid, ix ORDER BY load_ts DESC) AS rn FROM df_fields WHERE sid IS NOT NULL AND ix IS NOT NULL) WHERE rn = 1)",
    "hdr AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY load_ts DESC) AS rn FROM doc WHERE id IS NOT NULL) WHERE rn = 1)",
    "docs AS (SELECT id_article AS doc_id, TRY_CAST(replace(datum, '-', '') AS INT) AS date_int, docsrc, ressort2 AS section FROM hdr)",
    "opn AS (SELECT *, last_value(CASE WHEN coalesce(iob, '') <> 'I' THEN ix * 2 + (coalesce(iob, '') = 'B')::int END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY ix ROWS UNBOUNDED PRECEDING) AS o FROM tok)",
    "spn AS (SELECT * EXCLUDE (o), CASE WHEN iob IN ('B', 'I') AND o % 2 = 1 THEN (o - 1) // 2 END AS span FROM opn)",
    f"scr AS (SELECT *, [{', '.join(_score(c) for c in CLASSES)}] AS scores FROM spn)",
    f"cls AS (SELECT *, {CLASS} AS wclass, coalesce({GOOD}, false) OR span IS NOT NULL AS good, ({LEMMAS})[1] AS ent_id FROM scr)",
    "ent AS (SELECT sid, span AS ix, arg_min(coalesce(ner, '~'), ix) AS etype, string_agg(coalesce(word, ''), ' ' ORDER BY ix) AS entity FROM spn WHERE span IS NOT NULL GROUP BY sid, span)",
    _values(POLARITY, "lex", "word, kind, value"),
    _values(EMOTIONS, "emo", "word, kind"),
    _values([(w,) for w in STOP], "stp", "word"),
    "pol AS (SELECT word, max(kind) AS kind, arg_max(value, kind)::double AS value FROM lex GROUP BY word)",
    "nam AS (SELECT DISTINCT pid, unnest(list_distinct(list_concat([label], coalesce(aliases, [])))) AS name FROM gazetteer)",
    "wrd AS (SELECT sid, id_article AS doc_id, ix, ent_id AS word, CASE wclass WHEN 'NOUN' THEN 'NOUN' WHEN 'ADJ' THEN 'ADJ' WHEN 'VERB' THEN 'VERB' WHEN 'ADV' THEN 'ADVERB' END AS etype, ent_id IN (SELECT word FROM stp) AS is_stop FROM cls WHERE good AND span IS NULL)",
    "m_words AS (SELECT sid, doc_id, ix, word, etype, is_stop, NULL::varchar AS wid, NULL::double AS valence FROM wrd WHERE etype IS NOT NULL)",
    "m_polarity AS (SELECT w.sid, w.doc_id, w.ix, w.word, coalesce(p.kind, 'NEUT') AS etype, w.is_stop, NULL::varchar AS wid, CASE WHEN p.kind = 'NEG' THEN -p.value ELSE p.value END AS valence FROM wrd w LEFT JOIN pol p ON p.word = w.word)",
    "m_emotions AS (SELECT w.sid, w.doc_id, w.ix, w.word, e.kind AS etype, w.is_stop, NULL::varchar AS wid, NULL::double AS valence FROM wrd w JOIN emo e ON e.word = w.word)",
    "art AS (SELECT sid, min(id_article) AS doc_id, min(wert) AS wert FROM tok GROUP BY sid)",
    "wid AS (SELECT name, min(pid) AS pid FROM nam GROUP BY name)",
    "m_entities AS (SELECT e.sid, a.doc_id, e.ix, e.entity AS word, e.etype, e.entity IN (SELECT word FROM stp) AS is_stop, w.pid AS wid, NULL::double AS valence FROM ent e JOIN art a ON a.sid = e.sid LEFT JOIN wid w ON w.name = e.entity WHERE e.etype <> '~')",
    "vrb AS (SELECT sid, ix AS verb_ix, ent_id AS verb FROM cls WHERE wclass = 'VERB' AND good)",
]


def _arguments(name: str, relations: str) -> str:
    return f"""{name}(sid, verb_ix, ix, ent_id, good) AS (
        SELECT n.sid, v.verb_ix, n.ix, n.ent_id, n.good FROM cls n JOIN vrb v ON v.sid = n.sid AND v.verb_ix = n.ixDEP WHERE n.wclass = 'NOUN' AND n.good AND n.dep IN ({relations})
        UNION ALL SELECT c.sid, a.verb_ix, c.ix, c.ent_id, c.good FROM {name} a JOIN cls c ON c.sid = a.sid AND c.ixDEP = a.ix WHERE a.good AND c.wclass = 'NOUN' AND c.dep = 'cj' AND c.ix > c.ixDEP)"""


PARTS += [
    _arguments("sbj", "'sb', 'ph', 'sbp', 'sp', 'ep'"),
    _arguments("obj", "'nmc', 'mo', 'nk', 'mnr', 'oa', 'da', 'oa2', 'op', 'og', 'oc'"),
    "svo AS (SELECT s.sid, s.verb_ix, s.ent_id AS subj, v.verb, o.ent_id AS obj FROM sbj s JOIN obj o ON o.sid = s.sid AND o.verb_ix = s.verb_ix JOIN vrb v ON v.sid = s.sid AND v.verb_ix = s.verb_ix)",
    "lst AS (SELECT verb, list_sort(list_distinct(list(subj))) AS subj, list_sort(list_distinct(list(obj))) AS obj FROM svo GROUP BY sid, verb_ix, verb)",
    "prs AS (SELECT coalesce(p.kind, 'NEUT') AS polarity, l.subj[1] AS subj, l.obj[1] AS obj FROM lst l LEFT JOIN pol p ON p.word = l.verb)",
    "org AS (SELECT sid, translate(replace(string_agg(coalesce(word, ''), ' ' ORDER BY ix), chr(10), ' '), ',´', ';''') AS original FROM tok GROUP BY sid)",
    "par AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::bigint AS p, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))",
    r"inv AS (SELECT '/data/' || lower(source) || '/' || string_split(docid, '_')[1] || '_' || string_split(docid, '_')[2] AS path, coalesce(n_chars, 0) AS size, lower(source) AS main, string_split(docid, '_')[1] AS source, try_strptime(string_split(docid, '_')[2], '%Y%m%d')::date AS date FROM documents WHERE docid IS NOT NULL)",
    r"wds AS (SELECT doc_id, lower(trim(lang)) AS lang, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS words FROM documents WHERE lower(trim(lang)) IN ('de', 'en', 'es', 'fr') AND text IS NOT NULL)",
    "syl AS (SELECT *, list_transform(words, lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouyäöüáéíóúàèêâîôûëïœ]+')))) AS syl FROM wds)",
    """cnt AS (SELECT doc_id, lang, len(words)::bigint AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint AS n_chars, coalesce(list_sum(syl), 0)::bigint AS n_syll, len(list_filter(words, lambda w: length(w) >= 7))::bigint AS n_long,
        len(list_filter(syl, lambda n: n >= 3))::bigint AS n_poly, len(list_filter(syl, lambda n: n = 1))::bigint AS n_mono, greatest(1, len(regexp_extract_all(text, '[.!?]+')))::bigint AS n_sents FROM syl)""",
]
PRELUDE = "WITH RECURSIVE " + ",\n".join(PARTS) + "\n"
ORACLES: dict[str, str] = {}


def sql(name: str, body: str) -> None:
    ORACLES[name] = PRELUDE + body


# Metadata and counters
E = "coalesce({0}, '') AS {0}".format
sql("count_meta", f"SELECT {E('docsrc')}, {E('mediatype')}, count(*) AS n_docs FROM hdr GROUP BY ALL")
sql("count_meta_transformed", "SELECT ressort2, section, count(*) AS n_docs FROM (SELECT coalesce(ressort2, '') AS ressort2, trim(unnest(string_split(coalesce(ressort2, ''), ','))) AS section FROM hdr) GROUP BY ALL")
sql("sum_tokens_meta", f"SELECT {E('docsrc')}, {E('year')}, coalesce(sum(CASE WHEN regexp_matches(trim(tokens), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(tokens) AS BIGINT) END), 0)::bigint AS n_tokens FROM hdr GROUP BY ALL")
sql("avg_tokens_meta", f"SELECT {E('docsrc')}, count(*) AS n_docs, coalesce(sum(CASE WHEN regexp_matches(trim(tokens), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(tokens) AS BIGINT) END), 0)::bigint AS n_tokens, round(coalesce(sum(CASE WHEN regexp_matches(trim(tokens), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(tokens) AS BIGINT) END), 0)::double / count(*), 6) AS mean_tokens FROM hdr GROUP BY ALL")
sql("meta_keys", "SELECT key, count(*) AS n_docs FROM (SELECT unnest(list_filter(" + str([c for c in ("docsrc", "mediatype", "region", "ressort2", "tokens", "year", "dupl")]) + ", lambda k: k IS NOT NULL)) AS key, hdr.* FROM hdr) WHERE CASE key WHEN 'docsrc' THEN docsrc WHEN 'mediatype' THEN mediatype WHEN 'region' THEN region WHEN 'ressort2' THEN ressort2 WHEN 'tokens' THEN tokens WHEN 'year' THEN year ELSE dupl END IS NOT NULL GROUP BY key")
COUNT = "count(word) AS n_words, coalesce(sum(length(word)), 0)::bigint AS n_chars, count(*) FILTER (length(word) >= 7) AS n_long, count(DISTINCT sid) AS n_sents"
sql("text_counters", f"SELECT {COUNT} FROM tok")
sql("text_counters_by_source", f"SELECT docsrc, {COUNT} FROM tok GROUP BY docsrc")
sql("path_extract", "SELECT DISTINCT path, main, source, strftime(date, '%Y-%m-%d') AS date, year(date) AS year FROM inv")
sql("inventory_by_source", "SELECT source, count(*) AS n_files, sum(size)::bigint AS bytes FROM inv WHERE source IS NOT NULL GROUP BY source")
sql("inventory_by_year", "SELECT year(date) AS year, count(*) AS n_files, sum(size)::bigint AS bytes FROM inv WHERE date IS NOT NULL GROUP BY 1")
sql("inventory_batches", "SELECT path, (row_number() OVER (ORDER BY path) - 1) // 50 AS batch FROM (SELECT DISTINCT path FROM inv)")

# Readability
sql("readability_counts", "SELECT * FROM cnt")
W = "nullif(n_words, 0)::double"
sql("flesch", "SELECT doc_id, round(CASE lang " + " ".join(f"WHEN '{k}' THEN {a}::double - {b}::double * (n_words::double / n_sents) - {c}::double * (n_syll / {W})" for k, (a, b, c) in FLESCH.items()) + " END, 6) AS score FROM cnt")
for _v, (_p, _l, _g, _m, _c) in WIENER.items():
    sql(f"wiener_v{_v}", f"SELECT doc_id, round({_p * 100!r}::double * (n_poly / {W}) + {_l}::double * (n_words::double / n_sents) + {_g * 100!r}::double * (n_long / {W}) + ({_m * 100!r})::double * (n_mono / {W}) + ({_c})::double, 6) AS score FROM cnt")
sql("lix", f"SELECT doc_id, round(n_words::double / n_sents + 100::double * (n_long / {W}), 6) AS score FROM cnt")
sql("ari", f"SELECT doc_id, round(4.71::double * (n_chars / {W}) + 0.5::double * (n_words::double / n_sents) - 21.43::double, 6) AS score FROM cnt")

# Text functions
sql("attached_punctuation", r"SELECT doc_id, md5(replace(regexp_replace(regexp_replace(text, '\s+([?!.,;:)])', '\1', 'g'), '([(])\s+', '\1', 'g'), '*', '')) AS digest FROM documents")
sql("only_words", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'), '[^\p{L}\p{N}_]', ' ', 'g'), '\s+[a-zA-Z]\s+', ' ', 'g')) AS digest FROM documents")
sql("subtitles", "SELECT doc_id, p, trim(substring(text, instr(text, 'Utl.') + 6, instr(text, '=') - instr(text, 'Utl.') - 6)) AS subtitle, substring(text, instr(text, '=') + 2) AS rest FROM par WHERE instr(text, 'Utl.') > 0 AND instr(text, '=') > instr(text, 'Utl.')")
D = r"'^([\p{L}\p{N}_\s]+)\(([\p{L}\p{N}_\s/]+)\)[\s\-]+'"
sql("datelines", f"SELECT doc_id, p, trim(regexp_extract(text, {D}, 1)) AS place, trim(regexp_extract(text, {D}, 2)) AS agency, md5(substring(text, length(regexp_extract(text, {D}, 0)) + 1)) AS digest FROM par WHERE regexp_extract(text, {D}, 0) <> ''")
N = r"'(?:Bild[.:/0-9A-Za-z, ]{0,30}|Seit[en ]*[.:/0-9A-Za-z, ]{0,30})$'"
sql("final_notes", f"SELECT doc_id, p, regexp_extract(text, {N}, 0) AS note, md5(left(text, length(text) - length(regexp_extract(text, {N}, 0)))) AS digest FROM par WHERE regexp_extract(text, {N}, 0) <> ''")
J = "md5(array_to_string({}, chr(1))) AS digest".format
sql("wordpunct_tokens", rf"SELECT doc_id, len(t)::bigint AS n, {J('t')} FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+') AS t FROM documents)")
sql("good_words", f"SELECT word, count(*) AS n FROM tok WHERE {GOOD} GROUP BY word")
sql("filtered_sentences", rf"SELECT doc_id, {J('t')} FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '[^a-zA-ZüäöÜÄÖß0-9\-.\s]', '', 'g'), '[.\n ]'), lambda w: w <> '') AS t FROM documents)")
R = r"list_filter(regexp_split_to_array(lower(text), '[^a-za-züäöüäöß_\-]+'), lambda w: length(w) >= 3)"
sql("regex_tokens", f"SELECT doc_id, {J('t')} FROM (SELECT doc_id, {R} AS t FROM documents)")
sql("without_stop_words", f"SELECT doc_id, {J('t')} FROM (SELECT doc_id, list_filter({R}, lambda w: NOT list_contains(['die', 'der', 'das', 'und', 'mit'], w)) AS t FROM documents)")
sql("embedding_sentences", r"""SELECT doc_id, count(*) AS n, max(array_to_string(s, ' ')) AS longest FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(x), '\s+'), lambda w: length(w) > 2) AS s
    FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^a-zA-ZüäöÜÄÖß0-9.\s]', '', 'g'), '.')) AS x FROM documents)) WHERE len(s) > 0 GROUP BY doc_id""")
sql("article_text", "SELECT id_article, md5(string_agg(coalesce(word, ''), ' ' ORDER BY sid, ix)) AS digest FROM tok WHERE wert = 'inhalt' GROUP BY id_article")
sql("article_keywords", "SELECT id_article, string_agg(coalesce(word, ''), ', ' ORDER BY sid, ix) AS keywords FROM tok WHERE wert = 'stichwort' GROUP BY id_article")

MARKED = "SELECT *, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND docid IS NOT NULL AND NOT contains(text, '<')"
sql("document_texts", f"SELECT docid AS id, md5(array_to_string(list_transform(l, lambda x: lower(x)), ' ')) AS digest FROM ({MARKED})")
sql("filtered_documents", f"SELECT docid AS id FROM ({MARKED}) WHERE ressort2 = 'sport' OR source = 'NBLK'")
sql("paragraph_rows", f"SELECT docid AS id, (generate_subscripts(l, 1) - 1)::bigint AS p_ix, md5(lower(unnest(l))) AS digest FROM ({MARKED})")
sql("long_paragraphs", f"SELECT docsrc, ressort2, count(*) AS n FROM (SELECT source AS docsrc, coalesce(ressort2, '') AS ressort2, unnest(l) AS x FROM ({MARKED})) WHERE len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) > 3 GROUP BY ALL")
sql("document_attributes", f"SELECT 'docsrc' AS key, source AS value, count(*) AS n FROM ({MARKED}) GROUP BY source UNION ALL SELECT 'ressort2', coalesce(ressort2, ''), count(*) FROM ({MARKED}) GROUP BY 2")
sql("markup_pieces", "SELECT line_id, len(l)::bigint AS n, length(raw_line)::bigint AS n_chars FROM (SELECT line_id, raw_line, regexp_extract_all(raw_line, '(?s)<[^>]+>|<|[^<]+') AS l FROM vertical_lines WHERE raw_line IS NOT NULL) WHERE len(l) > 0")
sql("paragraph_nouns", "SELECT id_article, wert, string_agg(coalesce(word, ''), ' ' ORDER BY sid, ix) AS words FROM tok WHERE posTT = 'NN' GROUP BY id_article, wert")

# Word classes, spans and the vocabulary
sql("word_classes", "SELECT wclass, good, count(*) AS n FROM cls GROUP BY ALL")
sql("word_class_tokens", "SELECT sid, ix::bigint AS ix, wclass, ent_id FROM cls")
sql("class_scores", "SELECT class, sum(score) AS score FROM (SELECT generate_subscripts(scores, 1) - 1 AS class, unnest(scores) AS score FROM scr) GROUP BY class")
sql("iob_spans", "SELECT sid, ix::bigint AS ix, nullif(etype, '~') AS etype, entity FROM ent")
sql("span_counts", "SELECT entity, count(*) FILTER (etype = 'PER') AS PER, count(*) FILTER (etype = 'LOC') AS LOC, count(*) FILTER (etype = 'ORG') AS ORG, count(*) FILTER (etype = 'MISC') AS MISC FROM ent GROUP BY entity")
sql("noun_chunks", """, g AS (SELECT *, CASE WHEN isnan(ixNP) THEN NULL ELSE ixNP END AS np FROM cls WHERE good), h AS (SELECT *, lag(np) OVER w AS before, lag(ix) OVER w AS prev FROM g WINDOW w AS (PARTITION BY sid ORDER BY ix)),
    r AS (SELECT *, sum(CASE WHEN prev IS NULL OR np IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY ix) AS run FROM h), q AS (SELECT *, max(run) OVER (PARTITION BY sid) AS last_run FROM r)
    SELECT sid, min(ix)::bigint AS first_ix, np::bigint AS np, string_agg(ent_id, ' ' ORDER BY ix) AS words FROM q WHERE np IS NOT NULL AND run < last_run GROUP BY sid, run, np""".lstrip())
SEEN = f"""SELECT entity, count(*) AS freq, min((sid, ix, part)) AS first FROM (SELECT sid, ix, generate_subscripts(l, 1) - 1 AS part, unnest(l) AS entity FROM (SELECT sid, ix, {LEMMAS} AS l FROM spn WHERE span IS NULL)
    UNION ALL SELECT sid, ix, 0, entity FROM ent) WHERE entity <> '' GROUP BY entity"""
sql("entity_vocab_ids", f"SELECT entity, row_number() OVER (ORDER BY first, entity) - 1 AS ent_id, freq FROM ({SEEN})")
sql("negated_verbs", "SELECT sid, ix::bigint AS ix FROM cls c WHERE wclass = 'VERB' AND good AND EXISTS (SELECT 1 FROM tok n WHERE n.sid = c.sid AND n.ixDEP = c.ix AND n.dep = 'ng')")
sql("verb_spans", """, h AS (SELECT sid, ix AS head FROM cls WHERE wclass = 'VERB'), o AS (SELECT t.sid, t.ix, h.head, t.ix < h.head AS l, row_number() OVER (PARTITION BY t.sid, h.head, t.ix < h.head ORDER BY abs(t.ix - h.head)) AS rn FROM tok t JOIN h ON h.sid = t.sid AND h.head = t.ixDEP WHERE t.dep = 'ng')
    SELECT h.sid, h.head::bigint AS ix, coalesce(min(o.ix) FILTER (o.l), h.head)::bigint AS from_ix, coalesce(max(o.ix) FILTER (NOT o.l), h.head)::bigint AS to_ix FROM h LEFT JOIN o ON o.sid = h.sid AND o.head = h.head AND abs(o.ix - o.head) = o.rn GROUP BY h.sid, h.head""")
sql("tree_children", "SELECT sid, ixDEP::bigint AS head, count(*) FILTER (ix < ixDEP) AS n_left, count(*) FILTER (ix > ixDEP) AS n_right FROM tok WHERE ixDEP > 0 AND ix <> ixDEP GROUP BY sid, ixDEP")


# Networks
def pairs(source: str, pos1: str, pos2: str, same: bool, where: str = "NOT a.is_stop AND NOT b.is_stop", on: str = "a.sid = b.sid") -> str:
    less = "a.word < b.word" if same else "(a.ix, a.etype, a.word) IS DISTINCT FROM (b.ix, b.etype, b.word)"
    return f"SELECT a.sid, a.word AS n1, b.word AS n2 FROM {source} a JOIN {source} b ON {on} WHERE a.etype IN ({pos1}) AND b.etype IN ({pos2}) AND {less} AND {where}"


NOUNS = pairs("m_words", "'NOUN'", "'NOUN'", True)
BOTH = "(SELECT * FROM m_words UNION ALL SELECT * FROM m_entities)"
sql("cooc_sentence", f"SELECT n1, n2, count(*) AS weight FROM ({NOUNS}) GROUP BY n1, n2")
sql("cooc_sentence_stop", f"SELECT n1, n2, count(*) AS weight FROM ({pairs('m_words', chr(39) + 'NOUN' + chr(39), chr(39) + 'ADJ' + chr(39) + ', ' + chr(39) + 'VERB' + chr(39), False, 'true')}) GROUP BY n1, n2 HAVING count(*) > 2")
sql("cooc_same_kinds", f"SELECT n1, n2, count(*) AS weight FROM ({pairs('m_entities', chr(39) + 'LOC' + chr(39) + ', ' + chr(39) + 'ORG' + chr(39), chr(39) + 'ORG' + chr(39) + ', ' + chr(39) + 'PER' + chr(39), False)}) GROUP BY n1, n2")
KINDS3 = "'PER', 'LOC', 'ORG'"
sql("cooc_paragraph", f", p AS (SELECT m.*, a.wert FROM m_entities m JOIN art a ON a.sid = m.sid) SELECT n1, n2, count(*) AS weight FROM ({pairs('p', KINDS3, KINDS3, True, on='a.doc_id = b.doc_id AND a.wert IS NOT DISTINCT FROM b.wert AND a.sid <> b.sid')}) GROUP BY n1, n2")
sql("cooc_center", f", p AS (SELECT * REPLACE (lower(word) AS word) FROM {BOTH}) SELECT n1, n2, count(*) AS weight FROM ({pairs('p', chr(39) + 'ORG' + chr(39), chr(39) + 'NOUN' + chr(39) + ', ' + chr(39) + 'VERB' + chr(39), False)}) WHERE n1 = '{CENTER}' GROUP BY n1, n2")
sql("cooc_date_range", f", p AS (SELECT * FROM m_words WHERE doc_id IN (SELECT doc_id FROM docs WHERE date_int BETWEEN 20150101 AND 20171231 AND (contains(section, 'politik') OR contains(section, 'sport')))) SELECT n1, n2, count(*) AS weight FROM ({pairs('p', chr(39) + 'NOUN' + chr(39), chr(39) + 'NOUN' + chr(39), True)}) GROUP BY n1, n2")
sql("cooc_one_day", f", p AS (SELECT * FROM m_words WHERE doc_id IN (SELECT doc_id FROM docs WHERE date_int = 20170506 AND docsrc IN ('NBLK', 'TKUR', 'LAFU', 'HOPO', 'WIRU'))) SELECT n1, n2, count(*) AS weight FROM ({pairs('p', chr(39) + 'NOUN' + chr(39), chr(39) + 'NOUN' + chr(39), True)}) GROUP BY n1, n2")
sql("cooc_wid", f", p AS (SELECT * FROM {BOTH} WHERE wid IS NOT NULL OR etype <> 'NOUN') SELECT n1, n2, count(*) AS weight FROM ({pairs('p', chr(39) + 'LOC' + chr(39) + ', ' + chr(39) + 'NOUN' + chr(39), chr(39) + 'LOC' + chr(39) + ', ' + chr(39) + 'NOUN' + chr(39), True)}) GROUP BY n1, n2")
sql("occurrence", f"SELECT word, wid, count(*) AS weight FROM {BOTH} WHERE NOT is_stop AND etype IN ('NOUN', 'LOC', 'ORG') GROUP BY word, wid HAVING count(*) > 2")
sql("entity_freq_distinct", f"SELECT count(DISTINCT sid) AS n_sentences FROM {BOTH} WHERE word = 'verein'")
sql("entity_freq_wid", "SELECT wid, count(DISTINCT sid) AS n_sentences FROM m_entities WHERE wid IS NOT NULL GROUP BY wid")
ADJ = "SELECT a.sid, a.ent_id AS adjective, n.ent_id AS noun FROM cls a JOIN cls n ON n.sid = a.sid AND n.ix = a.ixDEP WHERE a.wclass = 'ADJ' AND a.good AND n.wclass = 'NOUN' AND n.good"
sql("assoc_adjectives", f"SELECT noun AS n1, adjective AS n2, count(*) AS weight FROM ({ADJ}) GROUP BY ALL")
sql("assoc_adjectives_entities", f"SELECT noun AS n1, adjective AS n2, count(*) AS weight FROM ({ADJ}) WHERE sid IN (SELECT sid FROM ent) AND noun IN (SELECT word FROM stp) AND adjective NOT IN (SELECT word FROM stp) GROUP BY ALL")
BAL = "SELECT sid, round(sum(CASE etype WHEN 'POS' THEN coalesce(valence, 0) ELSE -coalesce(valence, 0) END), 9) AS balance FROM m_polarity WHERE etype IN ('POS', 'NEG') GROUP BY sid"
SNA = f"SELECT n1, n2, CASE WHEN balance > 0 THEN 'Positive' WHEN balance < 0 THEN 'Negative' ELSE 'Neutral' END AS valence, count(*) AS weight FROM ({NOUNS}) p LEFT JOIN ({BAL}) b USING (sid) GROUP BY ALL"
RANKED = "SELECT *, row_number() OVER (PARTITION BY n1, n2 ORDER BY weight DESC, {0}) AS rank FROM ({1})".format
sql("sna_best_label", f"SELECT n1, n2, weight, valence FROM ({RANKED('valence', SNA)}) WHERE rank = 1")
sql("sna_ranked", f"SELECT n1, n2, valence, weight, rank FROM ({RANKED('valence', SNA)}) WHERE rank <= 2")
sql("emotion_weight", f"SELECT n1, n2, sum(n)::bigint AS weight FROM ({NOUNS}) p JOIN (SELECT sid, count(*) AS n FROM m_emotions WHERE etype IN ('FREUDE', 'FURCHT') GROUP BY sid) e USING (sid) GROUP BY n1, n2")
FELT = "SELECT sid, emotion, n FROM (SELECT sid, etype AS emotion, count(*) AS n, row_number() OVER (PARTITION BY sid ORDER BY count(*) DESC, etype) AS r FROM m_emotions GROUP BY sid, etype) WHERE r = 1"
MAXE = f"SELECT n1, n2, emotion, sum(n)::bigint AS weight FROM ({NOUNS}) p JOIN ({FELT}) e USING (sid) GROUP BY ALL"
sql("max_emotion", f"SELECT n1, n2, weight, emotion FROM ({RANKED('emotion', MAXE)}) WHERE rank = 1")
sql("valence_pairs", f"SELECT n1, n2, count(*) AS weight FROM ({NOUNS}) GROUP BY n1, n2")
sql("valence_sum", f"SELECT sid, round(balance, 6) AS balance FROM ({BAL})")
sql("pos_neg_neu_split", "SELECT etype, count(*) AS n FROM m_polarity GROUP BY etype")
sql("emotion_mentions", "SELECT etype, word, count(*) AS n FROM m_emotions GROUP BY ALL")
sql("stopword_flag", "SELECT etype, is_stop, count(*) AS n FROM m_words GROUP BY ALL")
sql("top_occurrence", "SELECT word, count(*) AS n FROM m_words GROUP BY word ORDER BY n DESC, word LIMIT 20")

# Subject, verb and object
sql("svo_triples", "SELECT sid, verb_ix::bigint AS verb_ix, subj, verb, obj FROM svo")
POLAR = "SELECT DISTINCT s.sid, s.subj AS n1, s.verb, s.obj AS n2, m.etype, m.valence FROM svo s JOIN m_polarity m ON m.sid = s.sid AND m.word = s.verb WHERE m.etype IN ('POS', 'NEG')"
SVOV = f"SELECT n1, n2, CASE etype WHEN 'POS' THEN 'Positive' ELSE 'Negative' END AS valence, count(DISTINCT (sid, verb)) AS weight FROM ({POLAR}) GROUP BY ALL"
sql("svo_pairs", f"SELECT n1, n2, weight, valence FROM ({RANKED('valence', SVOV)}) WHERE rank = 1")
sql("svo_polarity", f"SELECT n1, n2, count(*) AS weight, round(sum(valence), 6) AS valence FROM ({POLAR}) WHERE etype = 'NEG' GROUP BY n1, n2")
LISTED = "SELECT s.verb, s.{1} AS other, count(DISTINCT s.sid) AS n_sentences, arg_min(o.original, o.sid) AS example FROM (SELECT DISTINCT sid, verb, subj, obj FROM svo) s JOIN org o ON o.sid = s.sid WHERE s.{0} = 'lohnpreis' GROUP BY s.verb, s.{1}".format
sql("svo_list_example", LISTED("subj", "obj"))
sql("svo_list_example_object", LISTED("obj", "subj"))
sql("svo_lists", "SELECT verb, array_to_string(subj, ',') AS subj, array_to_string(obj, ',') AS obj, count(*) AS n FROM lst GROUP BY ALL")
SEL = "(VALUES ('lohnpreis'), ('verein'), ('jugendvertrag')) AS w(word)"
sql("svo_lookup", f"""SELECT word, CASE WHEN s AND NOT o THEN obj[1] WHEN o AND NOT s THEN subj[1] END AS other, CASE WHEN s AND o THEN verb || ';' || array_to_string(subj, ',') || ';' || array_to_string(obj, ',') END AS whole, count(*) AS n
    FROM (SELECT *, list_contains(subj, word) AS s, list_contains(obj, word) AS o FROM lst, {SEL}) WHERE s OR o GROUP BY ALL""")
sql("svo_partners", "SELECT CASE WHEN obj[1] = 'lohnpreis' THEN subj[1] ELSE obj[1] END AS other, count(*) AS n FROM lst WHERE list_contains(subj, 'lohnpreis') OR list_contains(obj, 'lohnpreis') GROUP BY ALL")
sql("svo_split", "SELECT p.kind AS polarity, verb, count(*) AS n FROM lst JOIN pol p ON p.word = verb GROUP BY ALL")
sql("so_sentiment", "SELECT polarity, subj, obj, count(*) AS n FROM prs GROUP BY ALL")
sql("neutral_verbs", f"SELECT verb, count(*) AS n FROM lst, {SEL} WHERE (list_contains(subj, word) OR list_contains(obj, word)) AND verb NOT IN (SELECT word FROM lex) GROUP BY verb")
sql("pair_partners", "SELECT CASE WHEN obj = 'lohnpreis' THEN subj ELSE obj END AS other, count(*) AS n FROM prs WHERE subj = 'lohnpreis' OR obj = 'lohnpreis' GROUP BY ALL")
sql("svo_bfs_depth2", """, e AS (SELECT node, other, count(*) AS n FROM (SELECT subj AS node, obj AS other FROM prs UNION ALL SELECT obj, subj FROM prs WHERE subj <> obj) GROUP BY ALL),
    s(node, level, place) AS (VALUES ('lohnpreis', 0, 0), ('verein', 0, 1)),
    l0 AS (SELECT e.node, e.other, e.n FROM e JOIN s ON s.node = e.node LEFT JOIN s v ON v.node = e.other WHERE v.node IS NULL OR (v.level, v.place, v.node) > (s.level, s.place, s.node)),
    f AS (SELECT DISTINCT other AS node, 1 AS level, 0 AS place FROM l0 WHERE other NOT IN (SELECT node FROM s)), v AS (SELECT * FROM s UNION ALL SELECT * FROM f),
    l1 AS (SELECT e.node, e.other, e.n FROM e JOIN f ON f.node = e.node LEFT JOIN v ON v.node = e.other WHERE v.node IS NULL OR (v.level, v.place, v.node) > (f.level, f.place, f.node))
    SELECT node, other AS neighbour, n FROM l0 UNION ALL SELECT node, other, n FROM l1""")

# Gazetteer
FOLD = "CASE WHEN upper({0}) = {0} AND lower({0}) <> {0} THEN {0} ELSE lower({0}) END".format
LOOK = f"SELECT {FOLD('w')} AS tok, pid, name, plen, pos FROM (SELECT pid, name, len(l) AS plen, generate_subscripts(l, 1) AS pos, unnest(l) AS w FROM (SELECT pid, name, list_filter(regexp_split_to_array(name, '\\s+'), lambda x: x <> '') AS l FROM nam WHERE name IS NOT NULL AND trim(name) <> ''))"
sql("lookup_table", f"SELECT tok, pid, plen::bigint AS plen, pos::bigint AS pos FROM ({LOOK})")
RUNS = f"SELECT DISTINCT sid, start, plen, pid FROM (SELECT t.sid, t.ix - l.pos + 1 AS start, l.plen, l.pid, l.name, count(DISTINCT l.pos) AS n FROM tok t JOIN ({{0}}) l ON l.tok = {FOLD('t.word')} GROUP BY ALL HAVING count(DISTINCT l.pos) = l.plen)".format
sql("gazetteer_match", f"SELECT sid, start::bigint AS start, plen::bigint AS plen, pid FROM ({RUNS(LOOK)})")
PLACE = f"SELECT * FROM ({LOOK}) WHERE pid IN (SELECT pid FROM gazetteer WHERE kind = 'place')"
sql("linked_places", f""", r AS ({RUNS(PLACE)}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, pid ORDER BY plen DESC, start) AS k FROM r) WHERE k = 1),
    h AS (SELECT DISTINCT t.sid, t.ix FROM tok t WHERE {FOLD('t.word')} IN (SELECT tok FROM ({PLACE}))), b AS (SELECT sid, ix, ix - row_number() OVER (PARTITION BY sid ORDER BY ix) AS block FROM h),
    c AS (SELECT o.*, b.block, coalesce(g.views, 0) AS views FROM o JOIN b ON b.sid = o.sid AND b.ix = o.start LEFT JOIN gazetteer g ON g.pid = o.pid)
    SELECT sid, start::bigint AS start, plen::bigint AS plen, pid FROM (SELECT *, row_number() OVER (PARTITION BY sid, block ORDER BY plen DESC, views DESC, start, pid) AS q FROM c) WHERE q = 1""")
sql("merged_vocabulary", "SELECT pid, CASE kind WHEN 'org' THEN upper(label) ELSE label END AS label FROM gazetteer")

PEOPLE = """, ppl AS (SELECT 'P:' || autor AS pid, string_split(autor, ' ')[1] AS fn, string_split(autor, ' ')[2] AS ln, count(*) AS views FROM hdr WHERE regexp_matches(autor, '^\\p{L}+ \\p{Lu}[\\p{L}\\-]+$') AND NOT regexp_matches(autor, '^(Red|RED|red)') GROUP BY autor HAVING count(*) >= 3),
    fst AS (SELECT pid, fn AS name FROM ppl WHERE length(fn) > 1 UNION SELECT pid, left(fn, 1) || '.' FROM ppl), lst_names AS (SELECT pid, unnest([ln, ln || 's']) AS name FROM ppl WHERE length(ln) > 1)
"""
sql("person_names", PEOPLE + "SELECT pid, name, 'first' AS part FROM fst UNION ALL SELECT pid, name, 'last' FROM lst_names")
TABLE = f"SELECT {FOLD('name')} AS tok, pid, name, 1 AS plen, 1 AS pos FROM {{0}}".format
LONGEST = "SELECT sid, pid, start, plen FROM (SELECT *, row_number() OVER (PARTITION BY sid, pid ORDER BY plen DESC, start) AS k FROM ({0})) WHERE k = 1".format
sql("linked_persons", PEOPLE + f""", f AS ({LONGEST(RUNS(TABLE('fst')))}), l AS ({LONGEST(RUNS(TABLE('lst_names')))}),
    h AS (SELECT DISTINCT t.sid, t.ix FROM tok t WHERE {FOLD('t.word')} IN (SELECT tok FROM ({TABLE('lst_names')}))), b AS (SELECT sid, ix, ix - row_number() OVER (PARTITION BY sid ORDER BY ix) AS block FROM h),
    j AS (SELECT l.*, a.doc_id, coalesce(f.start + f.plen = l.start, false) AS is_full, f.start AS f_start, f.plen AS f_len FROM l JOIN art a USING (sid) LEFT JOIN f ON f.sid = l.sid AND f.pid = l.pid),
    s AS (SELECT doc_id, pid, min(sid) AS first_sid FROM j WHERE is_full GROUP BY ALL),
    k AS (SELECT j.*, s.first_sid IS NOT NULL AS anywhere, j.is_full OR coalesce(s.first_sid < j.sid, false) AS resolved, p.views, p.views >= 6 AS politic FROM j LEFT JOIN s ON s.doc_id = j.doc_id AND s.pid = j.pid JOIN ppl p ON p.pid = j.pid),
    c AS (SELECT k.sid, k.doc_id, b.block, CASE WHEN resolved THEN 0 WHEN anywhere THEN 1 WHEN politic AND k.doc_id IN (SELECT doc_id FROM k WHERE resolved AND politic) THEN 2 ELSE 3 END AS tier, CASE WHEN is_full THEN f_len + plen ELSE plen END AS len, views, CASE WHEN is_full THEN f_start ELSE start END AS start, pid
        FROM k JOIN b ON b.sid = k.sid AND b.ix = k.start),
    r AS (SELECT *, row_number() OVER (PARTITION BY sid, block ORDER BY tier, len DESC, views DESC, start, pid) AS n FROM c)
    SELECT r.sid, r.doc_id AS id_article, r.start::int AS start, r.len::int AS plen, r.pid, tier < 3 AS resolved, coalesce(upper(left(t.word, 1)) = left(t.word, 1) AND lower(left(t.word, 1)) <> left(t.word, 1), false) AS cap FROM r JOIN tok t ON t.sid = r.sid AND t.ix = r.start WHERE n = 1""")

# Graphs
EDGES = f"SELECT n1 AS src, n2 AS dst, count(*) AS weight FROM ({NOUNS}) GROUP BY n1, n2 HAVING count(*) >= 2"
CLIQ = "SELECT a.word AS src, b.word AS dst, count(*) AS weight FROM m_words a JOIN m_words b ON a.sid = b.sid AND a.ix <= b.ix WHERE a.etype = 'NOUN' AND b.etype = 'NOUN' GROUP BY ALL"
NODES = f"SELECT src AS node FROM ({EDGES}) UNION SELECT dst FROM ({EDGES})"
sql("clique_edges", CLIQ)
sql("graph_nodes", f"SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM ({NODES})")
sql("multi_edges", f"SELECT src, dst, unnest(generate_series(1, weight)) AS n FROM ({EDGES})")
sql("undirected_edges", f"SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(weight)::bigint AS weight FROM ({CLIQ}) GROUP BY 1, 2")
DEG = f"SELECT node, count(*) AS degree, sum(weight)::bigint AS strength FROM (SELECT src AS node, weight FROM ({EDGES}) UNION ALL SELECT dst, weight FROM ({EDGES})) GROUP BY node"
sql("degree", DEG)
sql("graph_overview", f"SELECT n_nodes, n_edges, n_loops, total_weight, round(2.0::double * n_edges / (n_nodes * (n_nodes - 1)), 9) AS density FROM (SELECT count(*) AS n_nodes FROM ({NODES})), (SELECT count(*) AS n_edges, count(*) FILTER (src = dst) AS n_loops, sum(weight)::bigint AS total_weight FROM ({EDGES}))")
sql("graph_cut_off", f"SELECT src, dst, weight FROM ({EDGES}) WHERE weight >= 2 AND src IN (SELECT node FROM ({DEG}) WHERE degree >= 3) AND dst IN (SELECT node FROM ({DEG}) WHERE degree >= 3)")
sql("community_between_edges", f"SELECT left(src, 1) AS ca, left(dst, 1) AS cb, count(*) AS n_edges, sum(weight)::bigint AS weight FROM ({EDGES}) WHERE left(src, 1) <> left(dst, 1) GROUP BY 1, 2")
sql("connected_components", """, ed AS (SELECT DISTINCT subj AS a, obj AS b FROM prs WHERE subj IS NOT NULL AND obj IS NOT NULL), bi AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
    reach(node, other) AS (SELECT a, a FROM bi UNION SELECT r.node, e.b FROM reach r JOIN bi e ON e.a = r.other)
    SELECT node, min(other) AS component, count(*) AS size FROM reach GROUP BY node HAVING count(*) > 2""")
sql("node_sizes", "SELECT word AS node, count(*) AS n, count(*) * 70 + 100 AS size FROM m_words GROUP BY word")

XML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')".format
sql("graphml", f"""SELECT 1 AS section, node AS key, '<node id="' || {XML('node')} || '"/>' AS line FROM ({NODES}) UNION ALL
    SELECT 2, src || chr(1) || dst, '<edge source="' || {XML('src')} || '" target="' || {XML('dst')} || '"><data key="weight">' || weight || '</data></edge>' FROM ({EDGES}) UNION ALL
    SELECT 0, '', '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">' UNION ALL SELECT 3, '', '</graph></graphml>'""")

# Graph tables
sql("graph_documents", "SELECT id AS docid, replace(datum, '-', '') AS date, docsrc, replace(coalesce(ressort2, ''), ',', ';') AS ressort, coalesce(region, '') AS region, '' AS parser_params FROM hdr")
sql("graph_sentences", "SELECT sid, original FROM org")
sql("graph_field_edges", "SELECT DISTINCT CASE wert WHEN 'inhalt' THEN 'content' WHEN 'stichwort' THEN 'keywords' ELSE 'title' END AS part, sid, id_article AS docid FROM tok WHERE wert IN ('inhalt', 'stichwort', 'titel')")
sql("graph_mentions", "SELECT sid, doc_id, ix::bigint AS ix, word, etype, is_stop, wid, valence FROM (SELECT * FROM m_words UNION ALL SELECT * FROM m_entities UNION ALL SELECT * FROM m_polarity UNION ALL SELECT * FROM m_emotions)")
NVN = "SELECT DISTINCT subj || '-' || obj || '-' || verb || '-' || sid AS nvn_id, subj, verb, obj FROM svo"
sql("graph_svo_edges", f"SELECT role, nvn_id, word, word IN (SELECT word FROM stp) AS is_stop FROM (SELECT nvn_id, unnest(['subj', 'verb', 'obj']) AS role, unnest([subj, verb, obj]) AS word FROM ({NVN}))")
sql("graph_adjective_nouns", f"SELECT DISTINCT adjective || '-' || noun || '-' || sid AS an_id, sid, adjective, noun FROM ({ADJ})")
sql("graph_chunks", f"{ORACLES['noun_chunks'][len(PRELUDE):].split('SELECT sid, min(ix)')[0]} SELECT np::int || '-' || sid AS chunk_id, sid, ent_id AS word FROM q WHERE np IS NOT NULL AND run < last_run")
sql("graph_entities", f"""SELECT coalesce(p.kind, 'NEUT') AS polarity, ent_id, translate(replace(label, chr(10), ' '), ',´', ';''') AS label, wid, CASE WHEN p.kind = 'NEG' THEN -p.value ELSE p.value END AS valence
    FROM (SELECT v.ent_id, coalesce(n.name, v.entity) AS label, CASE WHEN n.name IS NOT NULL THEN v.entity END AS wid FROM (SELECT entity, row_number() OVER (ORDER BY first, entity) - 1 AS ent_id FROM ({SEEN})) v LEFT JOIN (SELECT pid, min(name) AS name FROM nam GROUP BY pid) n ON n.pid = v.entity) LEFT JOIN pol p ON p.word = lower(label)""")
sql("graph_class_words", "SELECT DISTINCT etype, word FROM m_words")
sql("labelled_by_substring", "SELECT DISTINCT word, 'Negative' AS label FROM m_words m WHERE EXISTS (SELECT 1 FROM lex l WHERE l.kind = 'NEG' AND contains(lower(m.word), lower(l.word)))")

# Files
FILES = """, fil AS (SELECT file_name AS path, string_agg(raw_line, chr(10) ORDER BY line_id) AS text FROM vertical_lines WHERE raw_line IS NOT NULL GROUP BY file_name),
    dcs AS (SELECT path, generate_subscripts(l, 1) - 1 AS doc_ix, unnest(l) AS doc FROM (SELECT path, regexp_extract_all(text, '(?s)<doc [^>]*>.*?</doc>') AS l FROM fil)),
    hds AS (SELECT *, regexp_extract(doc, '(?s)^<doc ([^>]*)>', 1) AS head FROM dcs),
    kvs AS (SELECT *, list_zip(regexp_extract_all(head, '([^=\\s]*)="([^"]*)"', 1), regexp_extract_all(head, '([^=\\s]*)="([^"]*)"', 2)) AS kv FROM hds),
    ids AS (SELECT *, list_filter(kv, lambda x: x[1] = 'id')[-1][2] AS id, list_filter(kv, lambda x: x[1] = 'docsrc')[-1][2] AS docsrc, list_filter(kv, lambda x: x[1] = 'tokens')[-1][2] AS tokens FROM kvs),
    fds AS (SELECT coalesce(id, path || '#' || doc_ix) AS doc_id, generate_subscripts(l, 1) - 1 AS f_ix, unnest(l) AS part FROM (SELECT *, regexp_extract_all(doc, '(?s)<field name="[^"]*">.*?</field>') AS l FROM ids)),
    sns AS (SELECT doc_id, f_ix, regexp_extract(part, '^<field name="([^"]*)">', 1) AS field, generate_subscripts(l, 1) - 1 AS s_ix, unnest(l) AS body FROM (SELECT *, regexp_extract_all(part, '(?s)<s>(.*?)</s>', 1) AS l FROM fds)),
    lns AS (SELECT doc_id, field, s_ix, doc_id || '.' || field || f_ix || '.' || s_ix AS sid, generate_subscripts(l, 1) - 1 AS w_ix, unnest(l) AS line
        FROM (SELECT *, list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '' AND NOT (starts_with(x, '<') AND NOT starts_with(x, '<' || chr(9)))) AS l FROM sns)),
    cel AS (SELECT *, string_split(line, chr(9)) AS c FROM lns)
"""
sql("vertical_headers", FILES + "SELECT path, doc_ix::bigint AS id_article, id, docsrc, tokens FROM ids")
INT = "CASE WHEN regexp_matches(trim(c[{0}]), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(c[{0}]) AS INT) END".format
sql("vertical_tokens", FILES + f"SELECT sid, w_ix::bigint AS w_ix, c[1] AS word, {INT(3)} AS ix, {INT(10)} AS \"ixDEP\", c[6] AS ner, c[12] AS lemma FROM cel WHERE len(c) = 16")
sql("vertical_malformed", FILES + "SELECT sid, len(c)::bigint AS n_columns FROM cel WHERE len(c) <> 16")
PART = "array_to_string(list_transform(list_sort(list({{'s': s_ix, 'w': w_ix, 'word': c[1]}}) FILTER (field = '{0}')), lambda x: x.word), '{1}')".format
sql("vertical_articles", FILES + f"SELECT doc_id, coalesce({PART('titel', ' ')}, '') AS titel, coalesce({PART('stichwort', ', ')}, '') AS stichwort, coalesce({PART('inhalt', ' ')}, '') AS text FROM cel WHERE len(c) = 16 GROUP BY doc_id")

# Sets, statements, windows
sql("set_operations", "SELECT part, count(*) AS n FROM (SELECT CASE WHEN a.word IS NULL THEN 'text' WHEN b.word IS NULL THEN 'gazetteer' ELSE 'both' END AS part FROM (SELECT DISTINCT name AS word FROM nam WHERE name IS NOT NULL) a FULL JOIN (SELECT DISTINCT word FROM m_entities) b ON a.word = b.word) GROUP BY part")
sql("subclass_closure", "SELECT 'WORLD' AS class UNION SELECT 'R' || r_regionkey FROM region UNION SELECT 'N' || n_nationkey FROM nation")
sql("typed_entities", "SELECT 'C' || c_custkey AS s, CASE WHEN n_regionkey IN (0, 1) THEN 'HERE' ELSE 'THERE' END AS type FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (0, 1, 2)")
sql("entity_records", "SELECT 'C' || c_custkey AS s, c_name AS label, 'N' || c_nationkey AS classes, 0::bigint AS n_above FROM customer")
sql("joined_values", "SELECT docsrc, coalesce(string_agg(DISTINCT mediatype, ';' ORDER BY mediatype), '') AS mediatype, count(DISTINCT mediatype) AS n FROM hdr GROUP BY docsrc")
sql("fixed_dates", "SELECT id, coalesce(strftime(TRY_CAST(string_split(datum_full, 'T')[1] AS DATE), '%Y-%m-%d'), '0001-01-01') AS date FROM hdr")
sql("event_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type AS kind, count(*) AS n FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2")

# Models
VEC = "SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings"
COS = "round(list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 6)"
sql("topn_similar", f"SELECT vec_id, round(s, 4) AS similarity FROM (SELECT e.vec_id, {COS} AS s FROM ({VEC}) e, (SELECT v FROM ({VEC}) WHERE vec_id = 7) q WHERE e.vec_id <> 7 ORDER BY s DESC, vec_id LIMIT 50)")
sql("analogy_vector", f""", x AS ({VEC}), q AS (SELECT list_transform(generate_series(1, 64), lambda i: b.v[i] + c.v[i] - a.v[i]) AS v FROM x a, x b, x c WHERE a.vec_id = 1 AND b.vec_id = 2 AND c.vec_id = 3)
    SELECT vec_id, round(s, 4) AS similarity FROM (SELECT e.vec_id, {COS} AS s FROM x e, q WHERE e.vec_id NOT IN (1, 2, 3) ORDER BY s DESC, vec_id LIMIT 20 OFFSET 1)""")
for _name, _body in list(ORACLES.items()):
    # A part of its own follows the shared ones.
    ORACLES[_name] = _body.replace(PRELUDE + ",", PRELUDE.rstrip() + ",")

"""The queries of the problems tagged llm as SQL, where SQL can state them."""

from __future__ import annotations

TOK = "WITH tok AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sid, ix ORDER BY load_ts DESC) AS rn FROM df_fields WHERE sid IS NOT NULL AND ix IS NOT NULL) WHERE rn = 1)"
BASE = "trim(lower(lemma), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
PARTS = f"list_distinct(list_filter(CASE WHEN {BASE} IS NOT NULL AND {BASE} NOT IN ('', '<unknown>') THEN string_split({BASE}, '|') WHEN word IS NOT NULL THEN [lower(word)] ELSE [] END, lambda x: x <> ''))"

COUNTS = (
    TOK
    + f""", each AS (SELECT id_article, unnest({PARTS}) AS term FROM tok WHERE id_article IS NOT NULL),
    total AS (SELECT count(DISTINCT id_article) AS n FROM tok), cnt AS (SELECT term, count(*) AS n_tokens, count(DISTINCT id_article) AS n_articles FROM each GROUP BY term),
    mrk AS (SELECT *, CASE WHEN n_articles <= 2 THEN 'rare' WHEN n_articles * 100 > 25 * (SELECT n FROM total) THEN 'common' END AS mark FROM cnt)
"""
)
LINES = (
    TOK
    + r""", wrd AS (SELECT *, regexp_replace(lower(word), '[^\p{L}]+', '', 'g') AS w FROM tok WHERE wert = 'inhalt'),
    lin AS (SELECT sid, min(id_article) AS id_article, min(docsrc) AS docsrc, string_agg(w, ' ' ORDER BY ix) FILTER (w <> '') AS line FROM wrd GROUP BY sid),
    sup AS (SELECT coalesce(docsrc, '') AS src, line FROM lin WHERE line <> '' GROUP BY 1, 2 HAVING count(DISTINCT id_article) >= 4),
    fnd AS (SELECT l.sid FROM lin l JOIN sup s ON s.src = coalesce(l.docsrc, '') AND s.line = l.line)
"""
)
PAIRS = (
    TOK
    + f""", held AS (SELECT DISTINCT sid, unnest({PARTS}) AS term FROM tok WHERE ner IS NOT NULL AND iob = 'B'), one AS (SELECT term, count(*) AS n FROM held GROUP BY term), total AS (SELECT count(DISTINCT sid) AS n FROM held),
    prs AS (SELECT a.term AS term_a, b.term AS term_b, count(*) AS n_ab FROM held a JOIN held b ON a.sid = b.sid AND a.term < b.term GROUP BY ALL),
    lft AS (SELECT p.*, x.n AS n_a, y.n AS n_b, t.n FROM prs p JOIN one x ON x.term = p.term_a JOIN one y ON y.term = p.term_b, total t)
"""
)
ORACLES = {
    "p3_found": COUNTS + "SELECT term, mark FROM mrk WHERE mark IS NOT NULL",
    "p3_counts": COUNTS + "SELECT term, n_tokens, n_articles, mark FROM mrk",
    "p5_found": LINES + "SELECT sid FROM fnd",
    "p5_clean": LINES
    + """, snt AS (SELECT sid, min(id_article) AS id_article, coalesce(string_agg(word, ' ' ORDER BY ix), '') AS text, sid IN (SELECT sid FROM fnd) AS gone FROM tok GROUP BY sid)
    SELECT id_article, count(*) FILTER (NOT gone) AS n_kept, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(text, chr(10) ORDER BY sid) FILTER (NOT gone), '') AS text FROM snt GROUP BY id_article""",
    # Decoding what was encoded gives the text again; null and empty texts have the same empty list of ids.
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_found": PAIRS + "SELECT term_a, term_b FROM lft WHERE n_ab >= 5 AND n_ab * n >= 4 * n_a * n_b",
    "p7_pairs": PAIRS + "SELECT term_a, term_b, n_ab, n_a, n_b, n, round(n_ab::double * n / (n_a::double * n_b), 6) AS lift, round(log2(n_ab::double * n / (n_a::double * n_b)), 6) AS pmi FROM lft",
}

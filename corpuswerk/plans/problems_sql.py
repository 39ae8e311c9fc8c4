"""The queries of the general problems as SQL, for comparison."""

from __future__ import annotations

from corpuswerk.operators.rowcheck import COLUMNS

OBJECTS = "CASE json_type({0}) WHEN 'OBJECT' THEN [{0}] WHEN 'ARRAY' THEN list_filter(CAST({0} AS JSON[]), lambda x: json_type(x) = 'OBJECT') ELSE [] END".format


def _each(table: str, keys: str, source: str, value: str) -> str:
    return f"{table} AS (SELECT {keys}, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS j FROM (SELECT {keys}, {value} AS l FROM {source}))"


NODES = "WITH " + ",\n".join(
    [
        "rec AS (SELECT rec_id, row_number() OVER () AS n, CAST(payload AS JSON) AS j FROM doc_nested WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT')",
        _each("fld", "rec_id, n", "rec", OBJECTS("(j->'field')")),
        "fs AS (SELECT rec_id, n, place AS f, j, " + OBJECTS("(j->'s')") + " AS own, list_transform(" + OBJECTS("(j->'p')") + ", lambda p: " + OBJECTS("(p->'s')") + ") AS inner_s FROM fld)",
        "snt AS (SELECT rec_id, n, f, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS j FROM (SELECT *, list_concat(own, coalesce(flatten(inner_s), [])) AS l FROM fs))",
        "tkn AS (SELECT rec_id, n, f, s, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS j FROM (SELECT rec_id, n, f, place AS s, " + OBJECTS("(j->'tok')") + " AS l FROM snt))",
        "cnd AS (SELECT rec_id, n, f, s, t, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS j FROM (SELECT rec_id, n, f, s, place AS t, " + OBJECTS("(j->'cand')") + " AS l FROM tkn))",
    ]
)
ORACLES: dict[str, str] = {
    "p1_found": NODES
    + """ SELECT rec_id, 'doc' AS lvl, (-1)::int AS field_ix, (-1)::int AS s_ix, (-1)::int AS tok_ix, (-1)::int AS cand_ix FROM rec
    UNION ALL SELECT rec_id, 'field', place::int, -1, -1, -1 FROM fld UNION ALL SELECT rec_id, 's', f::int, place::int, -1, -1 FROM snt
    UNION ALL SELECT rec_id, 'tok', f::int, s::int, place::int, -1 FROM tkn UNION ALL SELECT rec_id, 'cand', f::int, s::int, t::int, place::int FROM cnd""",
    "p1_rejected": "SELECT rec_id, NULL::bigint AS rec_part, CASE WHEN payload IS NULL THEN 'null' ELSE 'json' END AS reason FROM doc_nested WHERE payload IS NULL OR NOT json_valid(payload) OR json_type(payload) <> 'OBJECT'",
}


# A quoted cell that goes on after its closing quote is badly quoted, whatever comes then.
CELLS = r"""WITH lin AS (SELECT line_id, raw_line, starts_with(raw_line, '<') AND ends_with(raw_line, '>') AS markup FROM vertical_lines WHERE raw_line IS NOT NULL AND regexp_matches(raw_line, '\S')),
    cut AS (SELECT line_id, raw_line, regexp_extract_all(chr(9) || raw_line, '\t("[^"]*(?:""[^"]*)*"[^\t]*|[^\t]*)', 1) AS c FROM lin WHERE NOT markup),
    bad AS (SELECT *, len(list_filter(c, lambda x: contains(x, '"') AND NOT regexp_matches(x, '(?s)^"[^"]*(?:""[^"]*)*"$'))) > 0 AS misquoted FROM cut),
    val AS (SELECT *, list_transform(c, lambda x: CASE WHEN starts_with(x, '"') AND length(x) >= 2 THEN replace(substring(x, 2, length(x) - 2), '""', '"') ELSE x END) AS v FROM bad),
    jdg AS (SELECT *, CASE WHEN misquoted THEN 'quoting' WHEN len(c) <> 16 THEN 'columns' WHEN NOT regexp_matches(v[10], '^0*[0-9]{1,10}$') OR TRY_CAST(v[10] AS HUGEINT) > 2147483647 THEN 'ixdep'
        WHEN NOT regexp_matches(v[8], '^([0-9]+([.][0-9]+)?)?$') THEN 'ixnp' WHEN NOT regexp_matches(v[6], '^(PER|LOC|ORG|MISC)?$') THEN 'ner' END AS reason FROM val)
"""
ORACLES["p6_found"] = CELLS + "SELECT line_id, reason FROM jdg WHERE reason IS NOT NULL UNION ALL SELECT line_id, 'quoting' FROM lin WHERE markup AND (length(raw_line) - length(replace(raw_line, '\"', ''))) % 2 = 1"
WHOLE = "CASE WHEN regexp_matches(trim({0}), '^[+-]?[0-9]+$') THEN TRY_CAST(trim({0}) AS INT) END".format
FIELDS = [f'{WHOLE(f"v[{k}]") if c in ("ix", "ixDEP") else f"TRY_CAST(v[{k}] AS DOUBLE)" if c == "ixNP" else f"v[{k}]"} AS "{c}"' for k, c in enumerate(COLUMNS, 1)]
ORACLES["p6_rows"] = CELLS + f"SELECT line_id, {', '.join(FIELDS)} FROM jdg WHERE reason IS NULL"

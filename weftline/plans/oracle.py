"""DuckDB SQL for the queries: expressions for the functions, common tables for the views."""

from __future__ import annotations

from weftline.functions import lexicon as X


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _map(table: dict[str, str]) -> str:
    return f"MAP([{quoted(table)}], [{quoted(table.values())}])"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def fold(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


def split(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda s: s <> '')"


def mapped(tokens: str, table: dict[str, str]) -> str:
    return f"array_to_string(list_transform({tokens}, lambda t: coalesce(map_extract({_map(table)}, t)[1], t)), ' ')"


def norm_name(x: str) -> str:
    t = rf"regexp_replace(replace({fold(f'lower({strip(x)})')}, '&', ' and '), '[^a-z0-9\s]', ' ', 'g')"
    return f"regexp_replace({mapped(split(t), X.LEGAL_FORMS)}, '^the ', '')"


# The language's expressions have no lookahead; up to the next separator is the same.
_PHRASE = X.LANDMARK_PHRASE.replace("(?:^|[,;]|\\s+)", r"(?:^|[,;]|\s+)").replace(".*?(?=[,;]|$)", "[^,;]*")


def norm_addr(x: str) -> str:
    t = fold(f"lower({strip(x)})")
    t = f"regexp_replace(regexp_replace({t}, '{X.POSTAL_CODE}', ' ', 'g'), '{_PHRASE}', ' ', 'g')"
    t = rf"regexp_replace({t}, '[^a-z0-9\s]', ' ', 'g')"
    return mapped(split(t), X.ADDRESS_WORDS)


def landmark(x: str) -> str:
    return f"regexp_matches({fold(f'lower({strip(x)})')}, '{X.LANDMARK}')"


def pincode(x: str) -> str:
    return f"regexp_extract({fold(f'lower({strip(x)})')}, '{X.POSTAL_CODE}', 1)"


def tokens(x: str) -> str:
    return rf"list_filter(list_distinct(regexp_extract_all(lower({x}), '\b[a-z0-9]+\b')), lambda t: t NOT IN ({quoted(X.STOP_WORDS)}))"


def grams(x: str) -> str:
    words = f"list_transform({split(f'lower({x})')}, lambda s: ' ' || s || ' ')"
    every = "list_concat(" * 2 + "CASE WHEN len(p) >= 2 THEN [p[i:i+1] FOR i IN range(1, len(p))] ELSE [] END"
    every += ", CASE WHEN len(p) >= 3 THEN [p[i:i+2] FOR i IN range(1, len(p) - 1)] ELSE [] END)"
    every += ", CASE WHEN len(p) >= 4 THEN [p[i:i+3] FOR i IN range(1, len(p) - 2)] ELSE [] END)"
    return f"flatten([{every} FOR p IN {words}])"


ANY = r"[\p{L}\p{N}]+"


def words_of(x: str, pattern: str = ANY) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{pattern}')"


def without(ws: str, stop) -> str:
    return f"list_filter({ws}, lambda t: lower(t) NOT IN ({quoted(stop)}))"


def distinctive(x: str) -> str:
    w = without(words_of(x), X.GENERIC_TERMS)
    long = f"list_filter({w}, lambda t: length(t) >= 3)"
    return f"CASE WHEN len({long}) > 0 THEN {long} ELSE list_filter({w}, lambda t: length(t) >= 2) END"


def lcs(a: str, b: str) -> str:
    """Rows of the table as lists of numbers; a list of one number stands for a character."""
    chars = f"[[unicode(c)] FOR c IN string_split({a}, '')]"
    zeros = f"[0 FOR i IN range(0, length({b}) + 1)]"
    cells = f"list_reduce([[j] FOR j IN range(1, length({b}) + 1)], lambda cur, j: list_append(cur, CASE WHEN unicode({b}[j[1]]) = c[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], cur[j[1]]) END), [0::BIGINT])"
    rows = f"list_reduce({chars}, lambda prev, c: {cells}, {zeros})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE ({rows})[-1] END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * ({lcs(a, b)}) / (length({a}) + length({b})) END"


def in_order(x: str) -> str:
    return f"array_to_string(list_sort({split(x)}), ' ')"


def with_set_ratio(table: str, a: str, b: str, name: str) -> str:
    """The table with the word set ratio of two of its columns."""
    only = lambda x, y: f"array_to_string(list_sort(list_filter(list_distinct({x}), lambda s: NOT list_contains({y}, s))), ' ')"
    parts = f"(SELECT *, {split(a)} AS ws_x, {split(b)} AS ws_y FROM {table})"
    parts = f"(SELECT *, array_to_string(list_sort(list_intersect(list_distinct(ws_x), ws_y)), ' ') AS ws_i, {only('ws_x', 'ws_y')} AS ws_l, {only('ws_y', 'ws_x')} AS ws_r FROM {parts})"
    parts = f"(SELECT *, trim(ws_i || ' ' || ws_l) AS ws_p, trim(ws_i || ' ' || ws_r) AS ws_q FROM {parts})"
    value = f"""CASE WHEN len(ws_x) = 0 OR len(ws_y) = 0 THEN 0.0 WHEN ws_i <> '' AND (ws_l = '' OR ws_r = '') THEN 100.0 WHEN ws_i = '' THEN {ratio("ws_p", "ws_q")}
      ELSE greatest({ratio("ws_p", "ws_q")}, 200.0 * length(ws_i) / (length(ws_i) + length(ws_p)), 200.0 * length(ws_i) / (length(ws_i) + length(ws_q))) END"""
    return f"(SELECT * EXCLUDE (ws_x, ws_y, ws_i, ws_l, ws_r, ws_p, ws_q), {value} AS {name} FROM {parts})"


def rule_score(rules) -> str:
    """The score of the rules over name_words, addr_order, addr_words, a1, a2."""
    numbers = lambda x: rf"regexp_extract_all({x}, '\b\d+\b')"
    given, shared = f"{strip('a2')} <> ''", f"len(list_intersect({numbers('a1')}, {numbers('a2')})) > 0"
    evidence = {
        "no address": f"NOT ({given})",
        "address": given,
        "alike": f"{given} AND (addr_order >= 50 OR {shared} OR addr_words >= 60)",
        "close": f"{given} AND (addr_order >= 60 OR ({shared} AND addr_words >= 65))",
        "same place": f"{given} AND length(a1) > 5 AND addr_order >= 75",
    }
    measure = {"addr_order": "addr_order", "addr_best": "greatest(addr_order, addr_words)"}
    cases = " ".join(
        f"WHEN name_words >= {r.least} AND name_words < {r.below} AND {evidence[r.evidence]} THEN ({r.name}::DOUBLE * name_words + {r.address}::DOUBLE * {measure[r.measure]}) / 100" for r in rules
    )
    return f"CASE {cases} ELSE 0.0 END"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {both} > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / {both} ELSE 0.0 END"


def view(addressed: bool = False) -> str:
    """Tables w, e (raw entities) and n (normalised, with tokens)."""
    tail = " || ', ' || n_chars || ' Main St, Near ' || source || ', ' || lpad(doc_id::VARCHAR, 6, '0')" if addressed else ""
    return rf"""
w AS (SELECT *, {split("text")} AS ws, substr(source, 4)::INT AS k FROM documents),
e AS (SELECT CASE WHEN k <= 4 THEN 'S1-' WHEN k <= 12 THEN 'S2-' ELSE 'S3-' END || doc_id AS entity_id,
             array_to_string(ws[1:5], ' ') AS business_name, array_to_string(ws[6:14], ' '){tail} AS business_address, lang AS country,
             CASE WHEN k <= 4 THEN 1 WHEN k <= 12 THEN 2 ELSE 3 END AS src, text FROM w),
n0 AS MATERIALIZED (SELECT entity_id, src, country, text, business_name, business_address, {norm_name("business_name")} AS nn, {norm_addr("business_address")} AS na,
              {landmark("business_address")} AS lm, {pincode("business_address")} AS pc FROM e),
n AS MATERIALIZED (SELECT *, {tokens("nn")} AS nt, {tokens("na")} AS at FROM n0)"""


OVERLAP = """
tok AS (SELECT entity_id, src, country, unnest(nt) AS t FROM n),
overlap AS (SELECT a.entity_id AS source1_entity_id, b.entity_id AS candidate_id, count(*) AS c FROM tok a JOIN tok b ON a.t = b.t AND a.country = b.country
            WHERE a.src = 1 AND b.src > 1 GROUP BY ALL)"""
PAIRS = """
p AS MATERIALIZED (SELECT o.source1_entity_id, o.candidate_id, a.nn AS n1, b.nn AS n2, a.na AS a1, b.na AS a2, a.nt AS t1, b.nt AS t2, a.at AS u1, b.at AS u2, a.lm AS l1, b.lm AS l2,
      a.pc AS c1, b.pc AS c2, a.country AS country1, b.country AS country2, b.src AS src2, a.business_name AS r1, b.business_name AS r2, a.business_address AS s1, b.business_address AS s2
      FROM overlap o JOIN n a ON a.entity_id = o.source1_entity_id JOIN n b ON b.entity_id = o.candidate_id WHERE o.c >= {least})"""
SCORED = f"""
scored AS MATERIALIZED (SELECT source1_entity_id, candidate_id, n2, a2, country2, src2, round(({jaccard("t1", "t2")} + {jaccard("u1", "u2")}) / 2, 6) AS s FROM p)"""
TRUTH = """
truth AS MATERIALIZED (SELECT a.entity_id AS source1_entity_id, b.entity_id AS candidate_id FROM e a JOIN e b ON a.text = b.text WHERE a.src = 1 AND b.src > 1),
s1 AS (SELECT entity_id AS source1_entity_id, country FROM e WHERE src = 1),
nt AS (SELECT s1.source1_entity_id, count(truth.candidate_id) AS n_true FROM s1 LEFT JOIN truth USING (source1_entity_id) GROUP BY ALL)"""
SORTED = """
o AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY nn, src, entity_id) AS rn FROM n),
hood AS (SELECT DISTINCT CASE WHEN a.src = 1 THEN a.entity_id ELSE b.entity_id END AS source1_entity_id, CASE WHEN a.src = 1 THEN b.entity_id ELSE a.entity_id END AS candidate_id
         FROM o a JOIN o b ON a.country = b.country AND b.rn BETWEEN a.rn + 1 AND a.rn + 9 WHERE (a.src = 1) <> (b.src = 1))"""
TFIDF = f"""
g AS (SELECT entity_id, src, country, g, 1 + ln(count(*)) AS tf FROM (SELECT entity_id, src, country, unnest({grams("nn || ' ' || na")}) AS g FROM n) GROUP BY ALL),
df AS (SELECT country, g, count(*) AS df FROM g WHERE src > 1 GROUP BY ALL),
cn AS (SELECT country, count(*) AS n FROM n WHERE src > 1 GROUP BY ALL),
v AS (SELECT entity_id, src, country, g, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM g JOIN df USING (country, g) JOIN cn USING (country)),
u AS MATERIALIZED (SELECT entity_id, src, country, g, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS w FROM v),
dots AS (SELECT a.entity_id AS source1_entity_id, b.entity_id AS candidate_id, sum(a.w * b.w) AS s FROM u a JOIN u b ON a.country = b.country AND a.g = b.g WHERE a.src = 1 AND b.src > 1 GROUP BY ALL),
near AS (SELECT * FROM dots QUALIFY row_number() OVER (PARTITION BY source1_entity_id ORDER BY round(s, 9) DESC, candidate_id) <= 8),
held AS (SELECT source1_entity_id, count(*) AS k FROM near GROUP BY ALL),
pad AS (SELECT q.entity_id AS source1_entity_id, c.entity_id AS candidate_id, 0.0::DOUBLE AS s FROM n q JOIN n c ON q.country = c.country LEFT JOIN held h ON h.source1_entity_id = q.entity_id
        WHERE q.src = 1 AND c.src > 1 AND coalesce(k, 0) < 8 AND (q.entity_id, c.entity_id) NOT IN (SELECT (source1_entity_id, candidate_id) FROM near)
        QUALIFY row_number() OVER (PARTITION BY q.entity_id ORDER BY c.entity_id) <= 8 - coalesce(any_value(k) OVER (PARTITION BY q.entity_id), 0)),
top AS (SELECT source1_entity_id, candidate_id, s FROM near UNION ALL SELECT * FROM pad)"""


def f05(p: str, t: str, h: str) -> str:
    return f"CASE WHEN {p} = 0 AND {t} = 0 THEN 1.0 WHEN {p} = 0 OR {t} = 0 OR {h} = 0 THEN 0.0 ELSE 1.25 * ({h}::DOUBLE / {p}) * ({h}::DOUBLE / {t}) / (0.25 * ({h}::DOUBLE / {p}) + ({h}::DOUBLE / {t})) END"


def prec(p: str, t: str, h: str) -> str:
    return f"CASE WHEN {t} = 0 AND {p} > 0 THEN 0.0 WHEN {p} = 0 THEN 1.0 ELSE {h}::DOUBLE / {p} END"


def rec(p: str, t: str, h: str) -> str:
    return f"CASE WHEN {t} = 0 THEN CASE WHEN {p} = 0 THEN 1.0 ELSE 0.0 END ELSE {h}::DOUBLE / {t} END"

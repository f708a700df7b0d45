"""DuckDB SQL for the operators that SQL can express, plain and quadratic where need be: it runs on small tables."""

from __future__ import annotations

_WORD = "[^\\x20\\x09-\\x0D]+"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _reach(nodes: str, links: str) -> str:
    """CTEs: the pairs of ids that reach each other, and each id's smallest."""
    return f"""reach(a, b) AS (SELECT id, id FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON r.b = l.a),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)"""


def minhash() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '{_WORD}') AS ws FROM documents),
sh AS (SELECT id, array_to_string(ws[i:i+2], ' ') AS s FROM w, range(1, len(ws) - 1) t(i) WHERE len(ws) >= 3 UNION SELECT id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
n AS (SELECT id, count(DISTINCT s) AS n FROM sh GROUP BY 1),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.id <> y.id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON a = p.id JOIN n q ON b = q.id WHERE 100 * c >= 85 * (p.n + q.n - c)),
{_reach("w", "links")}
SELECT w.id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.id = component_id AS kept FROM w LEFT JOIN n USING (id) JOIN comp USING (id)"""


def vectors() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_reach("v", "links")}
SELECT v.id AS vec_id, CAST((SELECT count(*) FROM links WHERE a = v.id) AS BIGINT) AS n_links, component_id, v.id = component_id AS kept FROM v JOIN comp USING (id)"""


def substrings() -> str:
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM w, range(1, len(ws) - 11) t(i)),
first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM win JOIN first USING (g), range(0, 13) s(j) WHERE doc_id > m),
kept AS (SELECT doc_id, string_agg(ws[k], ' ' ORDER BY k) AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w) ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) r USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def top_k() -> str:
    return """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


#: The contract's three kinds and those that are added: name, gap before a match, match, group whose length counts,
#: and the least length.
_SECRETS = (
    ("assign", "(.*?)", """(?i:(password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "(.*?)", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "(.*?)", "[0-9a-f]+", 0, 32),
    ("pem", "(.*?)", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("forge", "(.*?)", "gh[opsu]_[A-Za-z0-9]{36,}", 0, 40),
    ("webtoken", "(.*?(?:^|[^A-Za-z0-9_-]))", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 30),
)


def secret_spans() -> str:
    parts, counts, base = [], [], ("assign", "access", "hex")
    for i, (kind, gap, match, group, least) in enumerate(_SECRETS):
        pattern = f"(?s){gap}({match})".replace("'", "''")
        value = f"regexp_extract_all(text, '{pattern}', {group + 2})" if group else "h"
        parts.append(f"""SELECT doc_id, {i} AS rank, '{kind}' AS kind, {least} AS least, g, h, {value} AS v FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}', 1) AS g, regexp_extract_all(text, '{pattern}', 2) AS h FROM d)""")
        if kind in base:
            counts.append(f"CAST(count(*) FILTER (WHERE kind = '{kind}') AS BIGINT) AS n_{kind}")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a FROM m, range(1, len(g) + 1) t(i)),
s AS (SELECT doc_id, rank, kind, a, kind || ':' || a || ':' || (a + length(h[i])) AS t FROM p WHERE length(v[i]) >= least),
f AS (SELECT doc_id, {", ".join(counts)}, string_agg(t, ',' ORDER BY a, rank) FILTER (WHERE rank < {len(base)}) AS base, string_agg(t, ',' ORDER BY a, rank) AS spans FROM s GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)"""


def collocations(longest: int = 3, least: int = 10, top: int = 2000, inside: int = 50) -> str:
    part = lambda a, b: f"array_to_string(ws[{a}:{b}], ' ')"
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, ws[i:i+k-1] AS ws FROM w, range(1, {longest + 1}) s(k), range(1, len(ws) - k + 2) t(i)),
f AS (SELECT lang, k, ws, {part(1, "k")} AS phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k >= 2 AND a >= {least}),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, j, x.a AS l, y.a AS r, 1000000 * c.a * c.a // (x.a * y.a) AS score FROM c, range(1, {longest}) t(j) JOIN f x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(c.ws[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(c.ws[j+1:], ' ') WHERE j < c.k QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1),
held AS (SELECT lang, {part("i", "i+m-1")} AS phrase, max(a) AS most FROM c, range(2, {longest}) s(m), range(1, k - m + 2) t(i) WHERE m < k GROUP BY 1, 2)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM cuts LEFT JOIN held USING (lang, phrase) JOIN n USING (lang) WHERE most IS NULL OR 100 * most < {inside} * a QUALIFY rank <= {top}"""


def filter_audit() -> str:
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
    bits = " | ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(("n < 200", "100 * len(list_distinct(ws)) < 50 * n", "100 * caps > 2 * length(t)", "regexp_matches(t, '[#$%&*|]')", "doc_id > least")))
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
e AS (SELECT *, len(ws) AS n, length(t) - length(translate(t, '{_AZ}', '')) AS caps, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, {bits} AS mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM e LEFT JOIN g USING (doc_id) GROUP BY 1, 2),
x(f, bit) AS {letters},
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bit, CAST(coalesce((SELECT sum(y.bit) FROM x y WHERE contains(left(filter_order, step - 1), y.f)), 0) AS INTEGER) AS before FROM o, range(1, 6) t(step) JOIN x ON x.f = filter_order[step]),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE mask & (before | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0) AS removed, sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0) AS redundant,
 sum(n) FILTER (WHERE mask = bit) AS unique_fails, sum(good) FILTER (WHERE mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit > 0) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM r"""

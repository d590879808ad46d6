"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from keyweave.llm import urlfilter

# --- personal data: the plain patterns, without what keeps Java's matcher linear --------------------------------------------

_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[oprsu]_[A-Za-z0-9]{36,255}\b|\bxox[abprs]-[A-Za-z0-9-]{10,255}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
    "secret": r"[A-Za-z0-9_/+-]{20,}={0,2}",
}
#: Kinds with context: their score, and the words that add 0.3 within 48 characters of the gap; 0.5 is needed.
_CONTEXT = {
    "iban": (0.8, "iban|account|bank"),
    "ssn": (0.3, "ssn|social security"),
    "key": (0.8, "key|secret|token|credentials?"),
    "secret": (0.3, "token|secret|password|passwd|api[_-]?key|access[_-]?key|credentials?|authorization|bearer"),
}
_DIGITS = "regexp_replace(s, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({_DIGITS}[length({_DIGITS}) - i] AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST({_DIGITS}[length({_DIGITS}) - i] AS INTEGER) + 1] END)) % 10 = 0"
_IBAN = "replace(s, ' ', '')"
_MOD97 = f"list_reduce(list_transform(string_split({_IBAN}[5:] || {_IBAN}[:4], ''), lambda c: CASE WHEN ascii(c) < 65 THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END) = 1"
_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(s, '.'), lambda x: length(ltrim(x, '0')) < 3 OR length(ltrim(x, '0')) = 3 AND ltrim(x, '0') <= '255'))",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": f"length({_IBAN}) BETWEEN 15 AND 34 AND {_MOD97}",
    "ssn": "NOT regexp_matches(s, '^(?:000|666|9..)|-00-|-0000$')",
    "key": "true",
    "secret": f"length(s) BETWEEN 20 AND 512 AND regexp_matches(s, '[A-Za-z]') AND length({_DIGITS}) >= 4",
}


def _kept(kind: str) -> str:
    score = ""
    if kind in _CONTEXT:
        least, context = _CONTEXT[kind]
        words = f"'(^|[^a-z])(?:{context})($|[^a-z])'"
        score = f" AND {least} + CASE WHEN regexp_matches(lower(right(g[i], 48)), {words}) OR regexp_matches(lower(left(g[i + 1], 48)), {words}) THEN 0.3 ELSE 0 END >= 0.5"
    return f"WHEN '{kind}' THEN {_VALID[kind]}{score}"


_COUNTED = ("email", "ip", "card", "phone")
_FOUND = " UNION ALL ".join(f"SELECT doc_id, {n} AS nth, '{k}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for n, (k, p) in enumerate(_PLAIN.items()))
_BASE = ", ".join(f"'{k}'" for k in _COUNTED)
PII = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_FOUND}),
x AS (SELECT doc_id, nth, kind, g, i, m[i] AS s, CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS a FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)),
k AS (SELECT doc_id, nth, kind, a, kind || ':' || a || ':' || (a + length(s)) AS line FROM x WHERE CASE kind {' '.join(map(_kept, _PLAIN))} END),
c AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _COUNTED)}, string_agg(line, ',' ORDER BY nth, a) FILTER (WHERE kind IN ({_BASE})) AS b, string_agg(line, ',' ORDER BY nth, a) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _COUNTED)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN c USING (doc_id)"""

# --- the others -----------------------------------------------------------------------------------------------------------------

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 10"""


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


_RANKED = sorted(urlfilter.RULES, key=lambda r: -len(r[1]))
_GLOB = {"**": ".*", "*": "[^/]*"}


def _regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob[i] == "*":
            star = "**" if glob[i : i + 2] == "**" else "*"
            out, i = out + _GLOB[star], i + len(star)
        else:
            out, i = out + (glob[i] if glob[i].isalnum() or glob[i] in "/-" else "\\" + glob[i]), i + 1
    return out


URLS = f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT *, CASE {' '.join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in _RANKED)} END AS rule FROM h)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in _RANKED)} {' '.join(f"WHEN regexp_full_match('.' || host || path, '{_regex(g)}', 's') THEN '{v}'" for v, g in urlfilter.GLOBS)} ELSE '{urlfilter.DEFAULT}' END AS verdict FROM r"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE = "CAST(('0x' || substring(hex, 5 * i + 1, 5)) AS INTEGER)"
WARC = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages), l AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(8), lambda i: {' || '.join(f"substring('{_BASE32}', CAST(({_FIVE} >> {b}) & 31 AS INTEGER) + 1, 1)" for b in (15, 10, 5, 0))}), '') AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM l"""

#: The rest of a line, behind three tokens, in six parts; two of them may be wildcards if four tokens stay.
_AT = "3 + (n - 3) * {} // 6"
_SIXTHS = [f"t[{_AT.format(j)} + 1 : {_AT.format(j + 1)}]" for j in range(6)]
_WILD = ", ".join(
    f"CASE WHEN n - 3 - len({_SIXTHS[a]}) - len({_SIXTHS[b]}) >= 4 THEN '{a}{b} ' || n || ' ' || array_to_string(t[1:3] || {' || '.join(p for i, p in enumerate(_SIXTHS) if i not in (a, b))}, ' ') END" for a in range(6) for b in range(a + 1, 6)
)
LINES = f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents), e AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM d)),
k AS (SELECT doc_id, i, line, len(t) AS n, t FROM (SELECT *, list_transform(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM e)),
y AS (SELECT doc_id, i, unnest(CASE WHEN n > 7 THEN ['all ' || array_to_string(t, ' '), {_WILD}] WHEN n > 0 THEN ['all ' || array_to_string(t, ' ')] ELSE [] END) AS key FROM k),
r AS (SELECT key, min(doc_id) AS first FROM y WHERE key IS NOT NULL GROUP BY key HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, i FROM y JOIN r USING (key) WHERE first < doc_id),
s AS (SELECT doc_id, count(*) FILTER (WHERE k.n > 0) AS n_lines, count(g.i) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.i IS NULL), '') AS kept FROM k LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(coalesce(kept, '')) AS n_chars, sha256(coalesce(kept, '')) AS text_sha256 FROM d LEFT JOIN s USING (doc_id)"""

ORACLES = {"op1_pii": PII, "op3_topk": TOPK, "op4_url_filter": URLS, "op6_warc": WARC, "op8_lines": LINES}

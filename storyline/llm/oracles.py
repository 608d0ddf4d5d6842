"""SQL twins, for DuckDB, of the training-data queries that SQL can express. They are written for plainness, and for small tables."""

from __future__ import annotations

from . import pii, secret_scan
from .quality_rules import Limits
from .warc_zip import LEAST_REVISIT

W = r"[^\x20\x09-\x0D]+"
S = r"[\x20\x09-\x0D]+"
_L = Limits()

QUALITY = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
y AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) >= 5),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram FROM y WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat FROM h, unnest([0, 1, 2, 3, 4]) AS u(j) WHERE n > 1 GROUP BY doc_id),
l0 AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT *, regexp_replace(trim(regexp_replace(lower(line), '{S}', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS norm, len(regexp_extract_all(line, '{W}')) AS n FROM l0 WHERE regexp_matches(line, '{W}')),
c AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM l GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT t) AS n_host FROM d GROUP BY source),
f AS (SELECT l.source, norm FROM l JOIN hosts ON hosts.source IS NOT DISTINCT FROM l.source GROUP BY l.source, norm, n_host
    HAVING count(DISTINCT t) >= {_L.min_docs} AND (count(DISTINCT t) >= {_L.enough_docs} OR 100 * count(DISTINCT t) > {_L.max_percent} * n_host)),
x AS (SELECT doc_id, sum(n) AS gone FROM l JOIN f ON f.norm = l.norm AND f.source IS NOT DISTINCT FROM l.source GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
    coalesce(n_repeat, 0) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_words FROM d LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)),
b AS (SELECT *, n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.max_repeat_percent} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND n_words - n_removed_words >= {_L.min_words} AND 100 * (n_words - n_removed_words) >= {_L.min_percent} * n_words AS kept FROM b"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= {LEAST_REVISIT} AND page_id IS NOT NULL THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM g) WHERE first < doc_id),
x AS (SELECT doc_id, list(i) AS starts FROM r GROUP BY doc_id),
k AS (SELECT doc_id, w, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS gone FROM d LEFT JOIN x USING (doc_id)),
y AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
z AS (SELECT doc_id, unnest(gone) AS i, 1 AS gone FROM k WHERE gone IS NOT NULL),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) FILTER (gone IS NULL) AS kept, count(gone) AS n_removed FROM y LEFT JOIN z USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""


def _places(kinds: list[tuple[str, str]]) -> str:
    """CTEs d, m, s: matches of each kind with their places: the lengths of the gaps and matches before them."""
    each = " UNION ALL ".join(f"SELECT doc_id, t, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for k, (kind, p) in enumerate(kinds))
    return f"""d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({each}), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m WHERE len(m) > 0),
    s AS (SELECT doc_id, t, k, kind, m[i] AS f, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a FROM i)"""


def _digest(base: list[str], spans: str) -> str:
    """The result's columns from table ``spans`` (doc_id, k, kind, a, b)."""
    told = lambda more="": f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k){more}, '')"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{name}" for k, name in enumerate(base))
    return f"SELECT d.doc_id, {counts}, sha256({told(f' FILTER (k < {len(base)})')}) AS base_sha256, {told()} AS spans FROM d LEFT JOIN {spans} x USING (doc_id) GROUP BY d.doc_id"


_DIGITS = "regexp_replace(f, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST({_DIGITS}[-j] AS INTEGER)
    WHEN CAST({_DIGITS}[-j] AS INTEGER) > 4 THEN CAST({_DIGITS}[-j] AS INTEGER) * 2 - 9 ELSE CAST({_DIGITS}[-j] AS INTEGER) * 2 END)) % 10 = 0"""
_BARE = "replace(f, ' ', '')"
_MOD = f"""list_reduce(list_prepend(0, list_transform(string_split({_BARE}[5:] || {_BARE}[1:4], ''), lambda c: ascii(c))), lambda acc, c: CASE WHEN c < 58 THEN (acc * 10 + c - 48) % 97 ELSE (acc * 100 + c - 55) % 97 END) = 1"""
_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
]
PII = f"""
WITH {_places(_PII)}, v AS (SELECT *, a + length(f) AS b FROM s WHERE CASE k WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(f, '.'), lambda x: coalesce(try_cast(x AS INTEGER), 999) > 255)) = 0
    WHEN 2 THEN length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}
    WHEN 3 THEN length({_DIGITS}) BETWEEN 9 AND 15
    WHEN 4 THEN length({_BARE}) BETWEEN 15 AND 34 AND {_MOD}
    ELSE NOT regexp_matches(f, '^(000|666|9)|-00-|-0000$') AND regexp_matches(lower(substr(t, greatest(1, a + 1 - {pii.NEARBY}), length(f) + 2 * {pii.NEARBY})), '{pii.CONTEXT["ssn"]}') END)
{_digest(pii.BASE, "v")}"""

_SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)[""'']?\x20*[:=]\x20*[""'']?[A-Za-z0-9+/_.=-]+""".replace('""', '"')),
    ("access", "AKIA[A-Z0-9]+"),
    ("hex", "[0-9a-f]+"),
    ("entropy", "[A-Za-z0-9+/_=-]{20,}"),
]
_VALUE = "length(regexp_extract(f, '" + _SECRETS[0][1].replace("[A-Za-z0-9+/_.=-]+", "([A-Za-z0-9+/_.=-]+)") + "', 1))"
_ALLOWED = " OR ".join(f"regexp_matches(f, '{p}')" for p in secret_scan.ALLOWED)
_BITS = {k: secret_scan.limit(v) for k, v in secret_scan.BITS.items()}
SECRETS = f"""
WITH {_places(_SECRETS)}, base AS (SELECT doc_id, k, kind, a, a + length(f) AS b FROM s WHERE CASE k WHEN 0 THEN {_VALUE} >= 6 WHEN 1 THEN length(f) >= 20 WHEN 2 THEN length(f) >= 24 ELSE false END),
c AS (SELECT *, CASE WHEN regexp_matches(f, '^([0-9a-f]+|[0-9A-F]+)$') THEN {_BITS["hex"]} WHEN regexp_matches(f, '^[A-Za-z0-9]+$') THEN {_BITS["alnum"]} ELSE {_BITS["base64"]} END AS most,
    unnest(range(1, length(f) - {secret_scan.WINDOW - 2})) AS i FROM s WHERE k = 3 AND NOT ({_ALLOWED})),
h AS (SELECT *, list_sum(list_transform(list_distinct(string_split(f[i:i+{secret_scan.WINDOW - 1}], '')),
    lambda ch: {secret_scan.PLOG}[length(f[i:i+{secret_scan.WINDOW - 1}]) - length(replace(f[i:i+{secret_scan.WINDOW - 1}], ch, '')) + 1])) AS total FROM c),
e AS (SELECT doc_id, 3 AS k, 'entropy' AS kind, a + min(i) - 1 AS a, a + max(i) + {secret_scan.WINDOW - 1} AS b FROM h WHERE total <= most GROUP BY doc_id, h.a),
v AS (SELECT * FROM base UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = e.doc_id AND base.a <= e.a AND base.b >= e.b))
{_digest(secret_scan.BASE, "v")}"""

# CRC-32 of an id's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384) ELSE u // 2 END)), 4294967295)"""
TRIE = f"""
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, len(regexp_extract_all(coalesce(text, ''), '{W}')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS i FROM t),
c AS (SELECT conv_id, {_CRC} % 4 AS h, conv_id - conv_id % 20 AS lender FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, o.i, o.d, o.w FROM c JOIN o ON o.conv_id = c.lender AND o.i <= c.h UNION ALL SELECT c.conv_id, 1, o.i, o.d, o.w FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h),
s AS (SELECT conv_id, list(d ORDER BY own, i) AS ds, list(w ORDER BY own, i) AS ws FROM r GROUP BY conv_id),
a AS (SELECT c.conv_id, coalesce(ds, []) AS ds, coalesce(ws, []) AS ws FROM c LEFT JOIN s USING (conv_id)),
x AS (SELECT conv_id, depth, array_to_string(ds[1:depth], '') AS k, CASE WHEN depth > 0 THEN array_to_string(ds[1:depth-1], '') END AS up, CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS w, len(ds) = depth AS ends
    FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS depth FROM a)),
n AS (SELECT depth, k, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(w) AS saves, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM x GROUP BY depth, k),
u AS (SELECT up AS k, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN u USING (depth, k)),
b AS (SELECT m.depth, m.k, count(*) FILTER (y.n_children = 0) AS n_leaves, CAST(sum(y.saves) AS BIGINT) AS saved_tokens FROM m JOIN m y ON y.depth >= m.depth AND starts_with(y.k, m.k) GROUP BY m.depth, m.k)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN b USING (depth, k) LEFT JOIN n q ON q.depth = m.depth - 1 AND q.k = m.up"""

ORACLE_SQL = {"op1_quality_rules": QUALITY, "op2_warc_zip": WARC, "op5_substring": SUBSTRING, "op7_pii": PII, "op10_secrets": SECRETS, "op13_prefix_trie": TRIE}

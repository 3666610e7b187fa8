"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from .quality import DIGITS, FEATURES, FENCE, LEAST_WORDS, MOST_REPEATS, PRIOR, WINDOW, _measures

SPACE, INK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def _sketch_bin(value: str) -> str:
    return f"({value} >> greatest(length(bin({value})) - {DIGITS}, 0)) << greatest(length(bin({value})) - {DIGITS}, 0)"


def quality_sql() -> str:
    value = lambda v: "(" + v.replace("div n_words", "// greatest(n_words, 1)") + ")"
    shared = {v: name for name, v in _measures()}
    rows = " UNION ALL ".join(f"SELECT lang, source, {name!r} AS feature, CAST({_sketch_bin(value(v))} AS BIGINT) AS bin FROM ok" for name, v in _measures())
    picks = ", ".join(f"min(bin) FILTER (feature = {name!r} AND 4 * c >= {q} * total) AS q{q}_{name}" for name, _ in _measures() for q in (1, 3))
    fences = []
    for name, v, side in FEATURES:
        q1, q3 = f"q1_{shared[v]}", f"q3_{shared[v]}"
        spread = f"{FENCE} * greatest({q3} - {q1}, 1)"
        fences.append((f"{q3} + {spread}" if side == "high" else f"greatest({q1} - {spread}, 0)") + f" AS f_{name}")
    mixed = lambda f, g: f"CAST((a.n * a.{f} + {PRIOR} * b.{g}) // (a.n + {PRIOR}) AS BIGINT) AS {f}"
    names = [f"f_{name}" for name, *_ in FEATURES]
    bad = " OR ".join(f"coalesce({value(v)} {'>' if side == 'high' else '<'} own.f_{name}, false)" for name, v, side in FEATURES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{INK}')) AS lines, t FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT r, words, unnest(range(1, length(words) - {WINDOW} + 2)) AS i FROM w WHERE length(words) >= {WINDOW})),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r),
f AS (SELECT d.doc_id, d.lang, d.source, length(words)::BIGINT AS n_words, length(regexp_replace(w.t, '{SPACE}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (length(lines) - length(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATS} * n_words AS base_failed FROM f),
ok AS (SELECT * FROM b WHERE NOT base_failed),
x AS ({rows}),
k AS (SELECT 2 AS level, lang, source, feature, bin, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 1, lang, NULL, feature, bin, count(*) FROM x GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, feature, bin, count(*) FROM x GROUP BY ALL),
c AS (SELECT level, lang, source, feature, bin, sum(n) OVER (PARTITION BY level, lang, source, feature ORDER BY bin) AS c, sum(n) OVER (PARTITION BY level, lang, source, feature) AS total FROM k),
q AS (SELECT level, lang, source, max(total) AS n, {picks} FROM c GROUP BY ALL),
t AS (SELECT level, lang, source, CAST(n AS BIGINT) AS n, {', '.join(fences)} FROM q),
lng AS (SELECT a.lang, {', '.join(mixed(f, f) for f in names)} FROM t a, t b WHERE a.level = 1 AND b.level = 0),
own AS (SELECT a.lang, a.source, {', '.join(mixed(f, f) for f in names)} FROM t a JOIN lng b ON a.lang IS NOT DISTINCT FROM b.lang WHERE a.level = 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({bad}) AS kept
FROM b LEFT JOIN own ON own.lang IS NOT DISTINCT FROM b.lang AND own.source IS NOT DISTINCT FROM b.source
"""


def leaks_sql() -> str:
    lower = lambda t: f"translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda t: rf"regexp_extract_all({lower(t)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS words FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words('text')} AS words FROM benchmark),
v AS (SELECT item, least(length(words), 10) AS n, array_to_string(words[i:i + 9], ' ') AS win FROM (SELECT item, words, unnest(range(1, greatest(length(words) - 9, 1) + 1)) AS i FROM b WHERE length(words) > 0)),
s AS (SELECT DISTINCT n FROM v),
g AS (SELECT r, i, n, array_to_string(words[i:i + n - 1], ' ') AS win FROM (SELECT r, words, n, unnest(range(1, length(words) - n + 2)) AS i FROM d, s WHERE length(words) >= n)),
h AS (SELECT r, i, g.n, item FROM g JOIN v USING (n, win)),
p AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM h),
run AS (SELECT r, min(p) AS a, max(p) AS z FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS o FROM p) GROUP BY r, o),
m AS (SELECT r, sum(z - a + 1)::BIGINT AS n_hit, string_agg(concat(CAST(a - 1 AS VARCHAR), ':', CAST(z AS VARCHAR)), ',' ORDER BY a) AS spans FROM run GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, length(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(spans, '') AS spans, coalesce(items, '') AS items FROM d LEFT JOIN m USING (r) LEFT JOIN n USING (r)
"""


def trie_sql() -> str:
    """Every conversation's prefixes spelled out as lists, which SQL can afford on small tables; CRC-32 bit by bit."""
    return """
    WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS d, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT DISTINCT c, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
        lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda v, i: CASE WHEN (v & 1) = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 9) AS h FROM t),
    r0 AS (SELECT i.c, 0 AS part, t.d, role, text FROM ids i JOIN t ON t.c = i.c - i.c % 5 AND t.d <= i.h UNION ALL SELECT i.c, 1, t.d, role, text FROM ids i JOIN t ON t.c = i.c AND t.d > i.h),
    r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, d) AS d, sha256(concat(length(role), ':', role, text)) AS label, octet_length(encode(text)) AS size FROM r0),
    w AS (SELECT i.c, count(r.d) AS n, coalesce(list(label ORDER BY d) FILTER (label IS NOT NULL), []) AS labels, coalesce(list(size ORDER BY d) FILTER (label IS NOT NULL), []) AS sizes FROM ids i LEFT JOIN r ON r.c = i.c GROUP BY 1),
    x AS (SELECT c, n, unnest(range(n + 1)) AS d, labels, sizes FROM w),
    p AS (SELECT c, n, d, sha256(concat(d, ':', array_to_string(labels[1:d], ','))) AS name, CASE WHEN d > 0 THEN sha256(concat(d - 1, ':', array_to_string(labels[1:d - 1], ','))) END AS above, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size FROM x),
    v AS (SELECT name, any_value(d) AS depth, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends FROM p GROUP BY name),
    k AS (SELECT v.*, coalesce(q.n, 0) AS n_children FROM v LEFT JOIN (SELECT above, count(*) AS n FROM v GROUP BY 1) q ON q.above = v.name),
    below AS (SELECT DISTINCT a.name, b.name AS under FROM p a JOIN p b ON a.c = b.c AND a.d <= b.d),
    s AS (SELECT below.name, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(k.saved)::BIGINT AS saved_tokens FROM below JOIN k ON k.name = below.under GROUP BY 1)
    SELECT k.conv_id, k.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(k.ends) AS ends_sha256 FROM k JOIN s ON s.name = k.name LEFT JOIN k u ON u.name = k.above"""


def warc_sql() -> str:
    return """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS url FROM pages),
    d AS (SELECT page_id, octet_length(encode(html)) AS bytes, sha256(html) AS digest, url FROM p),
    f AS (SELECT digest, min(page_id) AS first FROM d WHERE bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
    SELECT page_id, bytes AS payload_bytes, d.digest AS payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, url FROM d LEFT JOIN f ON f.digest = d.digest AND bytes >= 100"""

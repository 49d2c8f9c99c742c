"""The same results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

SPACES = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"

HOSTS = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
        list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{NO_SPACE}')) AS lines
    FROM documents
),
w AS (SELECT rid, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM d),
t AS (
    SELECT rid, i, w1, lead(w1, 1) OVER (PARTITION BY rid ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY rid ORDER BY i) AS w3
    FROM w
),
r AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w1, w2, w3) AS n FROM t WHERE w3 IS NOT NULL) WHERE n > 1
),
c AS (
    SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid
),
m AS (
    SELECT d.doc_id, d.source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
    FROM d LEFT JOIN c USING (rid)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
u AS (
    SELECT source, unnest(['short', 'repeats', 'symbols', 'word_length', 'dup_lines']) AS rule,
        unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words,
            word_chars < 3 * n_words OR word_chars > 10 * n_words, 10 * n_dup_lines > 3 * n_lines]) AS fails
    FROM b WHERE source IS NOT NULL
),
h AS (SELECT rule, source, count(*) AS n, count(*) FILTER (fails) AS failed FROM u GROUP BY rule, source),
p AS (
    SELECT rule, count(*) AS k, sum(n) AS total, sum(failed) / sum(n) AS mean,
        (sum(failed * failed / n) - sum(failed) * sum(failed) / sum(n)) / nullif(count(*) - 1, 0) AS between_,
        (sum(failed) - sum(failed * failed / n)) / nullif(sum(n) - count(*), 0) AS within_,
        (sum(n) - sum(n * n) / sum(n)) / nullif(count(*) - 1, 0) AS typical
    FROM h GROUP BY rule
),
g AS (
    SELECT rule, mean, greatest(least(coalesce(CASE WHEN between_ + (typical - 1) * within_ > 0
        THEN (between_ - within_) / (between_ + (typical - 1) * within_) END, 0), 1), 0) AS alike
    FROM p
),
v AS (
    SELECT DISTINCT source FROM h JOIN g USING (rule)
    WHERE mean + n * alike / (1 + (n - 1) * alike) * (failed / n - mean) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM v)) AS kept
FROM b
"""

REVISITS = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
f AS (
    SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

WHITE = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 32))

KNOWN_LINES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, coalesce(doc_id, -9223372036854775808) AS doc, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, coalesce(doc > first, false) AS gone FROM k LEFT JOIN o USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid
"""


def field(value: str) -> str:
    """A value as a Merkle leaf writes it."""
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


# Unsigned CRC-32 of the decimal doc_id, by its table of 256 remainders.
CRC_TABLE = """
SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
"""
CRC = """
xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, steps[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)
"""


def tree(name: str, leaves: str) -> str:
    """All nodes of trees of pairs over ``leaves(lang, pos, n, h)``, level by level."""
    return f"""{name} AS (
    SELECT lang, 0 AS lev, pos, n, h FROM {leaves}
    UNION ALL
    SELECT lang, lev + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
    FROM {name} WHERE n > 1 GROUP BY lang, lev, pos // 2
)"""


def climb(name: str, start: str, nodes: str) -> str:
    """What ``start(rid, lang, pos, n, folded, proof)`` folds to on the way up through ``nodes``."""
    return f"""{name} AS (
    SELECT rid, lang, 0 AS lev, pos, n, folded, proof FROM {start}
    UNION ALL
    SELECT c.rid, c.lang, c.lev + 1, c.pos // 2, (c.n + 1) // 2,
        sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.folded ELSE c.folded || coalesce(s.h, '') END), c.proof || coalesce(s.h, '')
    FROM {name} c LEFT JOIN {nodes} s
        ON s.lang IS NOT DISTINCT FROM c.lang AND s.lev = c.lev AND s.pos = CASE WHEN c.pos % 2 = 1 THEN c.pos - 1 ELSE c.pos + 1 END
    WHERE c.n > 1
)"""


MERKLE = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
r AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, {leaf("n_chars")} AS h,
        CASE WHEN {CRC} % 7 = 0 THEN {leaf("n_chars + 1")} ELSE {leaf("n_chars")} END AS folded
    FROM documents, crc
),
l AS (
    SELECT *, '' AS proof, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
    FROM r
),
{tree("low", "l")},
subroots AS (SELECT lang, h FROM low WHERE n = 1),
u AS (
    SELECT lang AS name, NULL AS lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM subroots
),
{tree("high", "u")},
{climb("first", "l", "low")},
half AS (
    SELECT f.rid, NULL AS lang, u.pos, u.n, f.folded, f.proof FROM first f JOIN u ON u.name IS NOT DISTINCT FROM f.lang WHERE f.n = 1
),
{climb("second", "half", "high")}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.h AS verified
FROM l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT h FROM high WHERE n = 1) t ON true
    JOIN second c ON c.rid = l.rid AND c.n = 1
"""

SQL: dict[str, str] = {
    "op3_warc_revisits": REVISITS,
    "op5_host_rules": HOSTS,
    "op11_line_runs": KNOWN_LINES,
    "op12_merkle_climb": MERKLE,
}

"""The registered queries as DuckDB SQL, worked out on other lines: window
functions, list functions and a recursive walk instead of the library's plans."""

from __future__ import annotations

import re
from dataclasses import replace

from ..functions.naming import ENV_NAMES, SELF_EXPLAINING
from ..functions.paths import (
    EXT_REASON,
    EXT_RULE,
    EXTENSIONS,
    NAME_PARTS,
    NAME_REASON,
    NAME_RULE,
    NAMES,
    PART_REASON,
    PART_RULE,
    STAGED_SKIP,
)
from ..functions.substitute import STYLES
from ..functions.text import EXPOSURE_WORDS
from ..operators import remediate
from ..options import HARMLESS, SKIP_GLOBS
from ..rules import RuleSet
from .queries import USER_RULES
from .corpus import DUCKDB, commits_sql, diffs_sql, files_sql, keys_sql, many_sql, pages_sql

RULES = RuleSet.default().rules
RUN = r"[\p{L}\p{N}_\-+=/.]"
DIRS = [g.removesuffix("/**") for g in SKIP_GLOBS if g.endswith("/**") and not g.startswith("*")]
ENDINGS = "(" + "|".join(re.escape(g[1:]) for g in SKIP_GLOBS if g.startswith("*.") and "/" not in g) + ")$"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def entropy(t: str) -> str:
    p = f"((length({t}) - length(replace({t}, c, ''))) / length({t}))"
    return f"coalesce(list_sum(list_transform(list_distinct(string_split({t}, '')), lambda c: -{p} * log2({p}))), 0.0)"


def longest(m: str) -> str:
    sizes = f"list_transform({m}, lambda x: length(x))"
    return f"{m}[list_position({sizes}, list_max({sizes}))]"


def lines_of(source: str, keys: str = "path", text: str = "text") -> str:
    return f"""SELECT {keys}, cast(generate_subscripts(l, 1) AS INTEGER) AS line, unnest(l) AS content
      FROM (SELECT {keys}, string_split({text}, chr(10)) AS l FROM {source}) split_"""


def located(raw: str, keys: str) -> str:
    """From matches, groups and the texts between them to tokens with offsets."""
    return f"""SELECT {keys}, content, rule_ord, rule, confidence, tk[i] AS token,
        cast(list_sum(list_transform(gp[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS s,
        cast(s + length(w[i]) AS INTEGER) AS e
      FROM (SELECT *, generate_subscripts(w, 1) AS i FROM ({raw}) r0) r1"""


def rule_hits(lines: str, keys: str = "path, line", rules=RULES) -> str:
    parts = []
    for i, r in enumerate(rules):
        p = q(r.pattern)
        parts.append(
            f"SELECT {keys}, content, {i} AS rule_ord, {q(r.name)} AS rule, cast({r.confidence} AS DOUBLE) AS confidence, "
            f"regexp_extract_all(content, {p}, 0) AS w, regexp_extract_all(content, {p}, {r.group}) AS tk, "
            f"regexp_split_to_array(content, {p}) AS gp FROM {lines} WHERE regexp_matches(content, {p})"
        )
    return located(" UNION ALL ".join(parts), keys)


def run_hits(lines: str, keys: str = "path, line", least: int = 20) -> str:
    p = q(f"{RUN}{{{least},}}")
    return located(
        f"SELECT {keys}, content, {len(RULES)} AS rule_ord, 'HIGH_ENTROPY' AS rule, cast(NULL AS DOUBLE) AS confidence, "
        f"regexp_extract_all(content, {p}, 0) AS w, w AS tk, regexp_split_to_array(content, {p}) AS gp "
        f"FROM {lines} WHERE regexp_matches(content, {p})",
        keys,
    )


def harmless(t: str) -> str:
    return "(" + " OR ".join(f"contains(lower({t}), {q(h.lower())})" for h in HARMLESS) + ")"


def entropy_hits(lines: str, keys: str = "path, line") -> str:
    return f"""SELECT * REPLACE (least(h / 8, 0.95) AS confidence) FROM (
        SELECT *, {entropy("token")} AS h FROM ({run_hits(lines, keys)}) t0
        WHERE length(token) <= 200 AND NOT {harmless("token")}) t1
      WHERE h >= 4.0"""


def snippet(c: str, s: str, e: str, context: int, show: int = 4) -> str:
    """Around a valid span; the other case is left to the caller."""
    return f"""concat(CASE WHEN {s} - {context} > 0 THEN '...' ELSE '' END,
        substring({c}, greatest(0, {s} - {context}) + 1, {s} - greatest(0, {s} - {context})),
        '***', CASE WHEN {e} - {s} <= {show} THEN '' ELSE substring({c}, {e} - {show} + 1, {show}) END,
        substring({c}, {e} + 1, {context}),
        CASE WHEN {e} + {context} < length({c}) THEN '...' ELSE '' END)"""


def hidden_snippet(c: str, m: str, s: str, e: str, context: int, show: int = 4) -> str:
    """``snippet`` with its surroundings from the starred line."""
    return snippet(m, s, e, context, show).replace(f"substring({m}, {e} - {show} + 1", f"substring({c}, {e} - {show} + 1")


def excluded_walk(more: tuple[str, ...] = ("reports", "data")) -> str:
    inside = f"len(list_filter(parts[1:len(parts) - 1], lambda x: list_contains({listed([*DIRS, *more])}, x) OR suffix(x, '.egg-info'))) > 0"
    ending = f"len(list_filter(parts, lambda x: regexp_matches(x, {q(ENDINGS)}))) > 0"
    return f"({inside} OR {ending} OR contains(path, '.DS_Store') OR contains(path, '.coverage'))"


def excluded_exact(more: tuple[str, ...] = ()) -> str:
    above = "parts[len(parts) - 1]"
    return (
        f"(coalesce(len(parts) > 1 AND (list_contains({listed([*DIRS, *more])}, {above}) OR suffix({above}, '.egg-info')), false) "
        f"OR regexp_matches(parts[len(parts)], {q(ENDINGS)}) OR contains(path, '.DS_Store') OR contains(path, '.coverage'))"
    )


def parted(source: str = "files") -> str:
    return (
        "SELECT *, parts[len(parts)] AS name, "
        "regexp_extract(parts[len(parts)], '^.+(\\.[^.]+)$', 1) AS ext "
        f"FROM (SELECT *, string_split(path, '/') AS parts FROM {source}) p0"
    )


def _of(reason: str, subject: str) -> str:
    a, b = reason.split("%s")
    return f"concat({q(a)}, {subject}, {q(b)})"


def name_finding() -> str:
    """``rule, confidence, reason`` of each path that has one."""
    rule, conf, reason = [], [], []
    for table, rname, subject, text in (
        (NAMES, NAME_RULE, "name", NAME_REASON),
        (EXTENSIONS, EXT_RULE, "lower(ext)", EXT_REASON),
    ):
        test = f"list_contains({listed(table)}, {subject})"
        rule.append(f"WHEN {test} THEN {q(rname)}")
        reason.append(f"WHEN {test} THEN {_of(text, subject)}")
        conf += [f"WHEN {subject} = {q(k)} THEN {v}" for k, v in table.items()]
    for part, v in NAME_PARTS.items():
        test = f"contains(lower(name), {q(part)})"
        rule.append(f"WHEN {test} THEN {q(PART_RULE)}")
        reason.append(f"WHEN {test} THEN {_of(PART_REASON, q(part))}")
        conf.append(f"WHEN {test} THEN {v}")
    return (
        f"CASE {' '.join(rule)} END AS rule, cast(CASE {' '.join(conf)} END AS DOUBLE) AS confidence, "
        f"CASE {' '.join(reason)} END AS reason"
    )


def env_name(rule: str, ordinal: str) -> str:
    base = f"replace(replace(upper({rule}), '-', '_'), ' ', '_')"
    known = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in ENV_NAMES.items())
    plain = " OR ".join(f"contains({base}, {q(w)})" for w in SELF_EXPLAINING)
    name = f"CASE {base} {known} ELSE CASE WHEN {plain} THEN {base} ELSE concat({base}, '_KEY') END END"
    return f"concat({name}, CASE WHEN {ordinal} > 0 THEN concat('_', cast({ordinal} + 1 AS VARCHAR)) ELSE '' END)"


FILES = f"files AS MATERIALIZED (SELECT path, text FROM ({files_sql('documents', DUCKDB)}) f0)"
LINES = f"{FILES}, lines AS MATERIALIZED ({lines_of('files')})"


def found_in(files: str, excluded: str, name: str = "found", keys: str = "") -> str:
    """CTEs for the combined scan of ``files``."""
    extra = f", {keys}" if keys else ""
    src = f"{name}_src"
    return f"""
    {src} AS MATERIALIZED (SELECT * FROM ({parted(files)}) s0 WHERE NOT {excluded}),
    {name}_lines AS MATERIALIZED ({lines_of(src, 'path' + extra)}),
    {name}_rules AS MATERIALIZED ({rule_hits(name + '_lines', 'path, line' + extra)}),
    {name}_runs AS MATERIALIZED ({entropy_hits(name + '_lines', 'path, line' + extra)}),
    {name} AS MATERIALIZED (
      SELECT path{extra}, 0 AS line, 0 AS "column", 0 AS "end", '' AS token, rule, confidence, reason AS snippet, 0 AS kind, -1 AS rule_ord, cast(NULL AS DOUBLE) AS h
      FROM (SELECT path{extra}, {name_finding()} FROM {src}) n0 WHERE rule IS NOT NULL
      UNION ALL
      SELECT path{extra}, line, s, e, token, rule, confidence, {snippet('content', 's', 'e', 30)}, 1, rule_ord, NULL FROM {name}_rules
      UNION ALL
      SELECT path{extra}, line, s, e, token, rule, confidence, {snippet('content', 's', 'e', 30)}, 2, rule_ord, h
      FROM (SELECT *, row_number() OVER (PARTITION BY path{extra}, line, token ORDER BY s) AS nth FROM {name}_runs) d0
      WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM {name}_rules r WHERE r.path = d0.path AND r.line = d0.line AND r.token = d0.token)
    )"""


FOUND = f"WITH {FILES}, {found_in('files', excluded_walk())}"
# The same with every span of the line starred out of a snippet but the last characters of its own.
STORED = f"""WITH {FILES}, {found_in('files', excluded_walk(), 'raw')},
    starred AS MATERIALIZED (
      SELECT path, line, content, array_to_string(list_transform(generate_series(1, length(content)),
          lambda i: CASE WHEN list_bool_or(list_transform(sp, lambda x: i > x.s AND i <= x.e)) THEN '*' ELSE substring(content, i, 1) END), '') AS stars
      FROM (SELECT path, line, list({{'s': "column", 'e': "end"}}) AS sp FROM raw WHERE line > 0 GROUP BY path, line) g0 JOIN raw_lines USING (path, line)),
    found AS MATERIALIZED (
      SELECT raw.* REPLACE (CASE WHEN raw.line = 0 THEN snippet ELSE {hidden_snippet('content', 'stars', '"column"', '"end"', 30)} END AS snippet)
      FROM raw LEFT JOIN starred USING (path, line))"""
PLAN = f"""{STORED}, plan AS MATERIALIZED (
      SELECT *, {env_name('rule', 'n')} AS env_var_name FROM (
        SELECT *, row_number() OVER (PARTITION BY rule ORDER BY path, line, kind, rule_ord, "column") - 1 AS n
        FROM found WHERE line > 0) p0)"""
PLACE = 'path, line, "column", rule'
SHOWN = f"{PLACE}, token, snippet, round(confidence, 9) AS confidence"

DIFFS = f"diffs AS MATERIALIZED ({diffs_sql('conversations', DUCKDB)})"
COMMITS = f"commits AS MATERIALIZED ({commits_sql('conversations', DUCKDB, 'list_value({0})').replace('list_value()', 'cast([] AS VARCHAR[])')})"


def added(source: str) -> str:
    """Added lines by a running count per hunk."""
    header = "content LIKE '@@%'"
    start = "coalesce(try_cast(trim(split_part(trim(split_part(split_part(content, '+', 2), '@@', 1)), ',', 1)) AS INTEGER), 0)"
    skipped = "(content LIKE '-%' OR content LIKE '+++%' OR content LIKE 'diff --git%' OR content LIKE '@@%')"
    return f"""SELECT * EXCLUDE (content, adv, hunk, start), substring(content, 2) AS content,
        cast(max(start) OVER h + coalesce(sum(adv) OVER (PARTITION BY sha, diff_ord, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line,
        content AS raw
      FROM (SELECT *, CASE WHEN {skipped} THEN 0 ELSE 1 END AS adv,
          CASE WHEN {header} THEN {start} ELSE 0 END AS start,
          sum(CASE WHEN {header} THEN 1 ELSE 0 END) OVER (PARTITION BY sha, diff_ord ORDER BY pos) AS hunk
        FROM (SELECT * EXCLUDE (l), generate_subscripts(l, 1) AS pos, unnest(l) AS content
          FROM (SELECT * EXCLUDE (patch), string_split(patch, chr(10)) AS l FROM {source}) a0) a1) a2
      WINDOW h AS (PARTITION BY sha, diff_ord, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


ADDED = f"added AS MATERIALIZED (SELECT sha, diff_ord, line, content FROM ({added('(SELECT sha, diff_ord, patch FROM diffs)')}) b0 WHERE raw LIKE '+%' AND raw NOT LIKE '+++%')"
LIVE = "live AS (SELECT sha, diff_ord, CASE WHEN b_path <> '' THEN b_path ELSE a_path END AS path, patch FROM diffs WHERE NOT deleted)"
LIVE_ADDED = f"live_added AS MATERIALIZED (SELECT sha, diff_ord, path, line, content FROM ({added('live')}) b0 WHERE raw LIKE '+%' AND raw NOT LIKE '+++%')"
_K = "sha, diff_ord, path, line"
COMMIT_FOUND = f"""{DIFFS}, {LIVE}, {LIVE_ADDED},
    all_hits AS MATERIALIZED (
      SELECT {_K}, content, token, s, e, rule, rule_ord, 1 AS kind FROM ({rule_hits('live_added', _K)}) c0
      UNION ALL
      SELECT {_K}, content, token, s, e, rule, rule_ord, 2 FROM ({entropy_hits('live_added', _K)}) c1),
    commit_found AS MATERIALIZED (
      SELECT *, {snippet('content', 's', 'e', 30)} AS snippet FROM (
        SELECT *, row_number() OVER (PARTITION BY sha, line, token ORDER BY diff_ord, kind, rule_ord, s) AS nth FROM all_hits) c2
      WHERE kind = 1 OR nth = 1)"""
META = """meta AS (SELECT sha, substring(sha, 1, 8) AS commit_sha, concat(author_name, ' <', author_email, '>') AS commit_author,
      strftime(make_timestamp(committed_at * 1000000), '%Y-%m-%d %H:%M:%S') AS commit_date,
      split_part(regexp_replace(message, '^\\s+|\\s+$', '', 'g'), chr(10), 1) AS commit_message, id FROM commits)"""
COMMIT_VIEW = 'commit_sha, path, line, s AS "column", rule, snippet, commit_author, commit_date, commit_message'


def reach(name: str, start: str) -> str:
    return f"""{name}(sha) AS (
      SELECT sha FROM commits WHERE id = ({start})
      UNION
      SELECT p.sha FROM (SELECT unnest(c.parents) AS sha FROM {name} r JOIN commits c ON c.sha = r.sha) p)"""


NEWEST = "SELECT max(id) FROM commits"
MIDDLE = "SELECT min(id) + (max(id) - min(id)) // 2 FROM commits"
RANGE = f"{reach('before', MIDDLE)}, {reach('after_', NEWEST)}, range_ AS (SELECT sha FROM after_ WHERE sha IN (SELECT sha FROM commits) AND sha NOT IN (SELECT sha FROM before))"

TOKENS = f"""tokens AS MATERIALIZED (SELECT path, line, cast(generate_subscripts(r, 1) - 1 AS INTEGER) AS nth, unnest(r) AS token
    FROM (SELECT path, line, regexp_extract_all(content, {q(RUN + '{20,}')}, 0) AS r FROM lines) k0)"""
WORDS = "words AS MATERIALIZED (SELECT DISTINCT unnest(string_split(content, ' ')) AS word FROM lines)"
SPANS = """spans AS (SELECT *, CASE WHEN n % 7 = 0 THEN n + 5 WHEN n % 7 = 1 THEN s ELSE s + n // 4 END AS e
    FROM (SELECT path, line, content, length(content) AS n, length(content) // 3 AS s FROM lines) s0)"""


def any_snippet(context: int, show: int) -> str:
    """The masked snippet, or the plain one for a span outside the text."""
    first, stop = f"greatest(0, s - {context})", f"least(n, e + {context})"
    plain = (
        f"concat(CASE WHEN {first} > 0 THEN '...' ELSE '' END, substring(content, {first} + 1, {stop} - {first}), "
        f"CASE WHEN {stop} < n THEN '...' ELSE '' END)"
    )
    return f"CASE WHEN s < {stop} AND e <= n THEN {snippet('content', 's', 'e', context, show)} ELSE {plain} END"


def plain_snippet(context: int) -> str:
    first, stop = f"greatest(0, s - {context})", f"least(n, e + {context})"
    return (
        f"concat(CASE WHEN {first} > 0 THEN '...' ELSE '' END, substring(content, {first} + 1, {stop} - {first}), "
        f"CASE WHEN {stop} < n THEN '...' ELSE '' END)"
    )


def masked(v: str, show: int = 4) -> str:
    return f"CASE WHEN length({v}) <= {show} THEN '***' ELSE concat('***', right({v}, {show})) END"


def literal() -> str:
    styles = [
        r'(?s)"([^"\\]*(?:\\.[^"\\]*)*)"',
        r"(?s)'([^'\\]*(?:\\.[^'\\]*)*)'",
        r'(?s)"""(.*?)"""',
        r"(?s)'''(.*?)'''",
        r"(?s)`([^`]*)`",
        r"([a-zA-Z0-9_\-+/=]{20,})",
    ]
    picks = [longest(f"regexp_extract_all(content, {q(s)}, 1)") for s in styles]
    return f"coalesce({', '.join(picks)})"


KIND = (
    "CASE WHEN lower(ext) = '.py' THEN 'python' "
    "WHEN list_contains(['.js', '.ts', '.jsx', '.tsx', '.mjs', '.cjs'], lower(ext)) THEN 'javascript' ELSE 'other' END"
)
KNOWN = f"""known AS MATERIALIZED (SELECT path, text, {KIND} AS kind, regexp_extract(text, 'K = "([0-9A-Za-z]+)"', 1) AS v FROM ({parted()}) k1)"""
PY_SWAP = "replace(text, concat('\"', v, '\"'), 'os.getenv(\"APP_KEY\")')"
JS_SWAP = "replace(text, concat('\"', v, '\"'), 'process.env.APP_KEY')"
ANY_SWAP = "replace(text, v, '${APP_KEY}')"


def with_import(text: str) -> str:
    """After the planted header of five lines."""
    l = f"string_split({text}, chr(10))"
    return f"array_to_string(list_concat({l}[1:5], ['import os'], {l}[6:]), chr(10))"


SWAPPED = f"CASE kind WHEN 'python' THEN {with_import(PY_SWAP)} WHEN 'javascript' THEN {JS_SWAP} ELSE {ANY_SWAP} END"


def replaced_all(kind: str, text: str = "r.text", value: str = "p.value") -> str:
    """One value replaced in a text, style by style, as SQL."""
    call = {"python": "concat('os.getenv(\"', p.env_var_name, '\")')", "javascript": "concat('process.env.', p.env_var_name)"}[kind]
    out, tests = text, []
    for prefix, quote in STYLES[kind]:
        out = f"replace({out}, concat({q(prefix + quote)}, {value}, {q(quote)}), {call})"
        if not prefix and len(quote) == 1:
            tests.append(f"contains({text}, concat({q(quote)}, {value}, {q(quote)}))")
    return f"CASE WHEN {' OR '.join(tests)} THEN {out} ELSE replace({text}, {value}, {call}) END"


# One value after another, each in the text that the last one left.
MANY = f"""keys AS MATERIALIZED ({keys_sql("documents", DUCKDB)}),
    many AS MATERIALIZED ({many_sql("documents", "keys", DUCKDB)}),
    r(path, j, text, replaced, outcomes) USING KEY (path) AS (
      SELECT path, cast(0 AS BIGINT), text, cast(0 AS BIGINT), '' FROM many
      UNION ALL
      SELECT r.path, p.j, CASE WHEN p.path LIKE '%.py' THEN {replaced_all("python")} WHEN p.path LIKE '%.ts' THEN {replaced_all("javascript")}
          ELSE replace(r.text, p.value, concat('${{', p.env_var_name, '}}')) END,
        r.replaced + CASE WHEN contains(r.text, p.value) THEN 1 ELSE 0 END,
        concat(r.outcomes, CASE WHEN p.j = 1 THEN '' ELSE '; ' END, p.env_var_name, ': ',
          CASE WHEN contains(r.text, p.value) THEN 'ok' ELSE {q(remediate.NOT_FOUND)} END)
      FROM r JOIN keys p ON p.path = r.path AND p.j = r.j + 1
    )"""
IMPORTED = """CASE WHEN path LIKE '%.py' AND replaced > 0 AND NOT contains(text, 'import os') AND NOT contains(text, 'from os import')
      THEN concat('import sys', chr(10), 'import os', substring(text, length('import sys') + 1)) ELSE text END"""
AVAILABLE = """avail AS (SELECT name, CASE WHEN f IN ('0','1','2') THEN '' WHEN f IN ('3','4') THEN substring(h, 1, 6) ELSE h END AS value
    FROM (SELECT name, sha256(name) AS h, substring(sha256(name), 1, 1) AS f FROM required) v0 WHERE f <> 'f')"""
CHECKED = f"""{PLAN}, required AS (SELECT DISTINCT env_var_name AS name FROM plan), {AVAILABLE},
    checked AS (SELECT r.name, coalesce(a.value, '') <> '' AS is_set,
      CASE WHEN coalesce(a.value, '') = '' THEN '' WHEN length(a.value) > 8 THEN concat(left(a.value, 4), '...', right(a.value, 4)) ELSE '***' END AS preview
      FROM required r LEFT JOIN avail a ON r.name = a.name)"""
BANDS = """count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium,
    count(*) FILTER (confidence < 0.5) AS low"""


def summary_of(source: str) -> str:
    return f"""SELECT count(*) AS total,
      coalesce((SELECT string_agg(concat(rule, '=', cast(n AS VARCHAR)), ',' ORDER BY rule) FROM (SELECT rule, count(*) AS n FROM {source} GROUP BY rule) g), '') AS by_rule,
      {BANDS}, count(DISTINCT path) AS files_affected FROM {source}"""


def gate_of(source: str, threshold: float) -> str:
    return f"""SELECT change_id, count(*) FILTER (confidence >= {threshold}) AS findings,
      round(max(confidence), 9) AS max_confidence, bool_or(confidence >= {threshold}) AS blocked FROM {source} GROUP BY change_id"""


def advice() -> str:
    rules = " ".join(f"WHEN {q(r.name)} THEN {q(r.remediation)}" for r in RULES)
    random = "Random-looking text (%.2f bits per character). If it is a secret, revoke it and read it from the environment."
    a, b = random.split("%.2f")
    return f"""CASE rule {rules}
      WHEN 'HIGH_ENTROPY' THEN concat({q(a)}, printf('%.2f', h), {q(b)})
      WHEN {q(NAME_RULE)} THEN concat('Keep ''', path_name, ''' out of version control and pass its values through the environment.')
      WHEN {q(EXT_RULE)} THEN concat('Check each ''', split_part(snippet, '''', 2), ''' file and keep key material in a secret store.')
      ELSE concat('The name holds ''', split_part(snippet, '''', 2), '''. Look through the file and move secrets to the environment.') END"""


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    o["src1_scan_directory"] = f"{FOUND} SELECT {SHOWN} FROM found WHERE cast(regexp_extract(path, '/d([0-9]+)/', 1) AS BIGINT) % 8 <> 3"
    exact = found_in("chosen", excluded_exact(("reports", "data")))
    o["src2_scan_files"] = f"""WITH {FILES}, chosen AS (SELECT * FROM files WHERE regexp_extract(path, '/d([0-9]+)/', 1) IN (SELECT cast(doc_id AS VARCHAR) FROM labels)),
      {exact} SELECT {SHOWN} FROM found"""
    single = found_in("files", excluded_exact(("reports", "data")))
    o["src3_scan_file"] = f"WITH {FILES}, {single} SELECT {SHOWN}, kind FROM found"
    o["src4_scan_text"] = (
        f'WITH {LINES} SELECT path, cast(line + 99 AS INTEGER) AS line, rule, token, s AS start, e AS "end" FROM ({rule_hits("lines")}) x'
    )
    o["src5_scan_history"] = f"""WITH {COMMITS}, {META}, {COMMIT_FOUND} SELECT {COMMIT_VIEW} FROM commit_found JOIN meta USING (sha)
      WHERE id IN (SELECT id FROM commits ORDER BY committed_at DESC, sha LIMIT 25)"""
    o["src6_scan_range"] = f"""WITH RECURSIVE {COMMITS}, {META}, {RANGE}, {COMMIT_FOUND} SELECT {COMMIT_VIEW} FROM commit_found JOIN meta USING (sha)
      WHERE sha IN (SELECT sha FROM range_)"""
    o["src7_commit_count"] = f"WITH RECURSIVE {COMMITS}, {reach('after_', NEWEST)} SELECT count(*) AS commits FROM after_ WHERE sha IN (SELECT sha FROM commits)"
    o["src8_added_lines"] = f"WITH {DIFFS}, {ADDED} SELECT sha, diff_ord, line, content FROM added"
    o["src9_commit_metadata"] = f"WITH {COMMITS}, {META} SELECT * EXCLUDE (id) FROM meta"
    kept = f"{PLACE}, snippet, round(confidence, 9) AS confidence"
    o["src10_load_findings"] = f"{STORED} SELECT {kept} FROM found WHERE confidence >= 0.7"
    o["snk1_save_findings"] = f"{STORED} SELECT {kept} FROM found WHERE confidence >= 0.9"
    o["snk2_append_log"] = "SELECT event_type AS reason, cast(floor(value) AS INTEGER) AS findings_bypassed, cast(user_id AS VARCHAR) AS user FROM events"
    o["snk3_migration_log"] = f"{FOUND} SELECT 2 * count(*) AS migrations, '2024-01-02 00:00:00' AS created_at, '2024-03-04 00:00:00' AS last_updated FROM found WHERE line > 0 AND confidence >= 0.95"
    o["snk4_override_log"] = "SELECT cast(user_id AS VARCHAR) AS user, count(*) AS overrides, cast(sum(cast(floor(value) AS INTEGER)) AS BIGINT) AS findings_bypassed FROM events GROUP BY user_id"

    o["flt1_exclude_paths"] = f"""WITH {FILES} SELECT path, {excluded_exact()} AS exact, {excluded_walk()} AS walk,
      contains(path, 'src1') OR suffix(path, '.md') AS custom, false AS empty_list FROM ({parted()}) x"""
    hexed = "substring(hex(encode({0})), 1, 16384)"
    pairs = f"regexp_extract_all({hexed}, '..', 0)"
    controls = f"len(list_filter({pairs}, lambda x: x < '20' AND x NOT IN ('09', '0A', '0D')))"
    binary = f"(list_contains({pairs}, '00') OR {controls} > 0.3 * len({pairs}))"
    noise = "concat(text, repeat(chr(1), cast(least(length(text), 3000) AS BIGINT)))"
    o["flt2_is_binary"] = f"""SELECT doc_id, {binary.format('text')} AS plain, strlen(text) < 8192 AS with_nul,
      {binary.format(noise)} AS with_noise, true AS unreadable FROM documents"""
    o["flt3_confidence_filter"] = f"{FOUND} SELECT {SHOWN} FROM found WHERE confidence >= 0.7"
    o["flt4_fixable"] = f"{FOUND} SELECT {PLACE} FROM found WHERE line > 0"
    o["flt5_entropy_length_gate"] = f"""WITH {LINES}, {TOKENS} SELECT path, line, nth, length(token) BETWEEN 20 AND 200 AS ok,
      length(token) * 5 BETWEEN 20 AND 200 AS long_ok, length(token) BETWEEN 30 AND 44 AS narrow_ok FROM tokens"""
    o["flt6_entropy_allowlist"] = f"""WITH {LINES}, {TOKENS} SELECT path, line, nth, {harmless('token')} AS as_found, true AS marked,
      contains(lower(token), 'ab') OR contains(lower(token), 'blob') AS extended FROM tokens"""
    words = " OR ".join(f"contains(lower(content), {q(w)})" for w in EXPOSURE_WORDS)
    o["flt7_secret_exposed"] = f"WITH {LINES} SELECT path, line FROM lines WHERE ({words}) AND (contains(content, '=') OR contains(content, ':'))"
    staged = " OR ".join(f"contains(path, {q(w)})" for w in STAGED_SKIP)
    o["flt8_staged_skip"] = f"WITH {FILES} SELECT path FROM files WHERE NOT ({staged}) AND text <> ''"
    o["flt9_deleted_skip"] = f"WITH {DIFFS}, {LIVE} SELECT sha, diff_ord, path FROM live"
    named = "(SELECT *, split_part(path, '/', -1) AS path_name FROM found) f"
    o["prj1_to_dict"] = f"{STORED} SELECT {kept}, {advice()} AS remediation FROM {named}"
    o["prj2_confidence_band"] = f"{FOUND} SELECT {PLACE}, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM found"
    o["prj3_confidence_level"] = f"""{FOUND} SELECT {PLACE},
      CASE WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS level,
      concat(printf('%.2f', confidence), CASE WHEN confidence >= 0.8 THEN ' strong' WHEN confidence >= 0.7 THEN ' warning' ELSE ' info' END) AS shown FROM found"""
    o["prj4_file_warning"] = f"""WITH {FILES} SELECT path, CASE WHEN rule IS NOT NULL THEN concat('WARNING: ', reason, ' (confidence: ', cast(cast(round(confidence * 100) AS INTEGER) AS VARCHAR), '%)') END AS warning
      FROM (SELECT path, {name_finding()} FROM ({parted()}) x) y"""

    o["det1_pattern_scan"] = f'WITH {LINES} SELECT path, line, rule, token, s AS start, e AS "end", confidence FROM ({rule_hits("lines")}) x'
    natural = """all_texts AS (SELECT concat('doc', cast(doc_id AS VARCHAR)) AS path, text FROM documents
      UNION ALL SELECT concat('talk', cast(conv_id AS VARCHAR), '.', cast(turn AS VARCHAR)), text FROM conversations
      UNION ALL SELECT concat('page', cast(page_id AS VARCHAR)), html FROM pages)"""
    o["det1_natural_text"] = f'WITH {natural}, lines AS MATERIALIZED ({lines_of("all_texts")}) SELECT path, line, rule, token, s AS start, e AS "end" FROM ({rule_hits("lines")}) x'
    o["det2_entropy_scan"] = f'WITH {LINES} SELECT path, line, token, s AS start, e AS "end", round(h, 9) AS entropy, round(confidence, 9) AS confidence FROM ({entropy_hits("lines")}) x'
    o["det3_filename_scan"] = f"WITH {FILES} SELECT * FROM (SELECT path, {name_finding()} FROM ({parted()}) x) y WHERE rule IS NOT NULL"
    o["det4_combined_scan"] = f'{FOUND} SELECT {SHOWN}, kind, "end" FROM found'
    user = [replace(RULES[0], name=n, pattern=p, confidence=0.8, group=1) for n, p in USER_RULES]
    o["det4_user_rules"] = f"""WITH {FILES}, own AS (SELECT * FROM ({parted()}) s0 WHERE NOT {excluded_walk()}),
      own_lines AS MATERIALIZED ({lines_of("own")}) SELECT path, line, s AS "column", rule, token FROM ({rule_hits("own_lines", rules=user)}) u0"""
    o["det4_web_pages"] = f"WITH web AS MATERIALIZED ({pages_sql('pages', DUCKDB)}), {found_in('web', excluded_walk())} SELECT {SHOWN} FROM found"
    o["det5_commit_scan"] = f'WITH {COMMIT_FOUND} SELECT sha, diff_ord, path, line, s AS "column", rule, token, snippet FROM commit_found'
    catalogue = ", ".join(f"({i}, {q(r.name)}, {q(r.pattern)}, {r.group}, cast({r.confidence} AS DOUBLE))" for i, r in enumerate(RULES))
    o["det6_rule_info"] = f"""WITH {LINES}, counted AS (SELECT rule, count(*) AS n FROM ({rule_hits('lines')}) x GROUP BY rule)
      SELECT rule_ord, rule, pattern, group_idx, confidence, coalesce(n, 0) AS findings FROM (VALUES {catalogue}) v(rule_ord, rule, pattern, group_idx, confidence) LEFT JOIN counted USING (rule)"""

    o["jon1_rule_enrich"] = f"WITH {LINES} SELECT path, line, s AS start, rule, rule_ord, confidence FROM ({rule_hits('lines')}) x"
    o["jon2_entropy_anti_pattern"] = f"""WITH {LINES}, r AS ({rule_hits('lines')}) SELECT path, line, token, s AS start FROM ({entropy_hits('lines')}) x
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.path = x.path AND r.line = x.line AND r.token = x.token)"""
    o["jon3_plan_apply"] = f"""{PLAN} SELECT p.path, cast(count(*) AS INTEGER) AS migrations, cast(any_value(length(f.text)) AS INTEGER) AS chars
      FROM plan p JOIN files f USING (path) GROUP BY p.path"""
    o["jon4_env_check"] = f"{CHECKED} SELECT name, is_set, preview FROM checked ORDER BY name"
    edited = "fixed AS (SELECT path, replace(replace(text, 'AKIA', 'none'), 'blob ', 'blobs ') AS text FROM files)"
    o["jon5_rescan_delta"] = f"""{FOUND}, {edited}, {found_in('fixed', excluded_walk(), 'again')}
      SELECT coalesce(f.path, a.path) AS path, coalesce(f.line, a.line) AS line, coalesce(f.rule, a.rule) AS rule, coalesce(f."column", a."column") AS "column",
      CASE WHEN a.path IS NULL THEN 'resolved' WHEN f.path IS NULL THEN 'new' ELSE 'remaining' END AS status
      FROM (SELECT DISTINCT {PLACE} FROM found) f FULL JOIN (SELECT DISTINCT {PLACE} FROM again) a
        ON f.path = a.path AND f.line = a.line AND f.rule = a.rule AND f."column" = a."column\""""

    o["agg1_summary"] = f"{FOUND} {summary_of('found')}"
    o["agg1_summary_empty"] = f"{FOUND}, none AS (SELECT * FROM found WHERE confidence >= 1.5) {summary_of('none')}"
    o["agg2_by_rule"] = f"{FOUND} SELECT rule, count(*) AS findings FROM found GROUP BY rule"
    o["agg3_stats"] = f"""{FOUND}, gaps AS (SELECT CASE WHEN line > 5 THEN path ELSE '' END AS path, CASE WHEN "column" < 10 THEN confidence ELSE 0 END AS confidence FROM found)
      SELECT count(*) AS total, {BANDS}, count(DISTINCT path) AS files_affected FROM gaps"""
    o["agg4_group_by_file"] = f"""{FOUND} SELECT path, count(*) AS findings, min(line) AS first_line, max(line) AS last_line, round(max(confidence), 9) AS max_confidence,
      count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium FROM found GROUP BY path"""
    o["agg4_listed_by_file"] = f"""{STORED}, placed AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, "column", rule) - 1 AS nth FROM found)
      SELECT path, nth // 3 AS chunk, string_agg(concat(line, ':', "column", ' ', rule, ' ', snippet), chr(10) ORDER BY nth) AS listing FROM placed GROUP BY path, nth // 3"""
    o["agg5_fix_summary"] = f"""{PLAN} SELECT count(*) AS migrations, count(DISTINCT path) AS files, count(DISTINCT env_var_name) AS env_vars,
      (SELECT count(*) FROM found WHERE confidence < 0.55) AS skipped FROM plan"""
    o["agg6_verify_summary"] = f"{CHECKED} SELECT count(*) AS total, count(*) FILTER (is_set) AS set_count, count(*) FILTER (NOT is_set) AS missing, count(*) FILTER (NOT is_set) = 0 AS all_set FROM checked"
    o["agg6_missing_names"] = f"""{CHECKED} SELECT nth // 10 AS chunk, string_agg(name, ' ' ORDER BY nth) AS names
      FROM (SELECT name, row_number() OVER (ORDER BY name) - 1 AS nth FROM checked WHERE NOT is_set) m GROUP BY nth // 10"""
    o["agg7_refactor_summary"] = f"WITH {FILES} SELECT count(*) FILTER (length(text) % 5 <> 4) AS succeeded, count(*) FILTER (length(text) % 5 = 4) AS failed FROM files"
    change = f"changed AS (SELECT concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) AS change_id, path, text FROM files WHERE NOT ({staged}) AND text <> '')"
    o["agg8_gate"] = f"WITH {FILES}, {change}, {found_in('changed', excluded_exact(('reports', 'data')), keys='change_id')} {gate_of('found', 0.7)}"
    o["agg9_exit_status"] = f"{FOUND} SELECT count(*) AS reported, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_status FROM found WHERE confidence >= 0.97"
    o["agg10_char_histogram"] = f"""WITH {LINES}, {TOKENS} SELECT token, ch, cast(count(*) AS INTEGER) AS n
      FROM (SELECT token, unnest(string_split(token, '')) AS ch FROM (SELECT DISTINCT token FROM tokens) t0) t1 GROUP BY token, ch"""

    o["win1_env_ordinal"] = f"""{FOUND} SELECT {PLACE}, cast(row_number() OVER (PARTITION BY rule ORDER BY path, line, kind, rule_ord, "column") - 1 AS INTEGER) AS ordinal FROM found WHERE line > 0"""
    o["win2_diff_line_no"] = f"""WITH {DIFFS}, {ADDED} SELECT sha, diff_ord, count(*) AS added, min(line) AS "first", max(line) AS "last", cast(sum(line) AS BIGINT) AS total FROM added GROUP BY sha, diff_ord"""
    o["ded1_file_dedup"] = f"""WITH {LINES}, r AS MATERIALIZED ({rule_hits('lines')}) SELECT path, line, s AS "column", rule, token FROM r
      UNION ALL SELECT path, line, min(s), rule, token FROM ({entropy_hits('lines')}) x
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.path = x.path AND r.line = x.line AND r.token = x.token) GROUP BY path, line, rule, token"""
    o["ded2_commit_dedup"] = f'WITH {COMMIT_FOUND} SELECT sha, diff_ord, line, s AS "column", token FROM commit_found WHERE kind = 2'
    o["srt1_report_order"] = f'{STORED} SELECT {kept} FROM found ORDER BY path, line, "column", rule'
    o["srt2_env_order"] = f"{PLAN} SELECT DISTINCT env_var_name AS name FROM plan ORDER BY name"
    o["lim1_newest_commits"] = f"WITH {COMMITS} SELECT sha, committed_at FROM commits ORDER BY committed_at DESC, sha LIMIT 25"
    o["top1_longest_literal"] = f"WITH {LINES} SELECT path, line, {longest('w')} AS longest FROM (SELECT path, line, string_split(content, ' ') AS w FROM lines) x"

    o["set1_union_detectors"] = f"""WITH {LINES} SELECT path, 0 AS line, 0 AS start, rule FROM (SELECT path, {name_finding()} FROM ({parted()}) x) y WHERE rule IS NOT NULL
      UNION ALL SELECT path, line, s, rule FROM ({rule_hits('lines')}) z UNION ALL SELECT path, line, s, rule FROM ({entropy_hits('lines')}) e"""
    log_names = f"""SELECT {env_name('rule', 'n')} AS name FROM (SELECT rule, row_number() OVER (PARTITION BY rule ORDER BY path, line, kind, rule_ord, "column") - 1 AS n FROM found WHERE line > 0 AND confidence >= 0.9) l0"""
    o["set2_env_union"] = f"{PLAN} SELECT env_var_name AS name FROM plan UNION {log_names}"
    o["set3_commit_range"] = f"WITH RECURSIVE {COMMITS}, {RANGE} SELECT sha FROM range_"

    o["sca1_shannon_entropy"] = f"WITH {LINES}, {TOKENS} SELECT path, line, nth, round({entropy('token')}, 9) AS entropy FROM tokens"
    o["sca2_is_high_entropy"] = f"""WITH {LINES} SELECT path, count(*) AS words, count(*) FILTER (h >= 3.0 AND length(word) >= 12) AS high, round(sum(h), 6) AS total
      FROM (SELECT path, word, CASE WHEN length(word) < 12 THEN 0.0 ELSE {entropy('word')} END AS h FROM (SELECT path, unnest(string_split(content, ' ')) AS word FROM lines) w0) w1 GROUP BY path"""
    o["sca3_entropy_confidence"] = f"WITH {LINES}, {TOKENS} SELECT path, line, nth, round(least(h / 8, 0.95), 9) AS confidence, round(least(h / 4, 0.95), 9) AS capped FROM (SELECT *, {entropy('token')} AS h FROM tokens) x"
    o["sca4_extract_tokens"] = f"""WITH {LINES} SELECT path, line, token, round(h, 9) AS entropy, s AS start, e AS "end" FROM (
      SELECT *, {entropy('token')} AS h FROM ({run_hits('lines', least=12)}) x WHERE length(token) <= 60) y WHERE h >= 3.5"""
    o["sca5_redact_secret"] = f"WITH {LINES}, {WORDS} SELECT word, {masked('word')} AS masked, {masked('word', 2)} AS masked2 FROM words"
    o["sca6_redact_line"] = f"""WITH {LINES}, {SPANS} SELECT path, line, CASE WHEN e > n OR s >= e THEN content
      ELSE concat(substring(content, 1, s), {masked('substring(content, s + 1, e - s)')}, substring(content, e + 1)) END AS redacted FROM spans"""
    o["sca7_create_snippet"] = f"WITH {LINES}, {SPANS} SELECT path, line, {plain_snippet(10)} AS snippet FROM spans"
    o["sca8_redact_snippet"] = f"WITH {LINES}, {SPANS} SELECT path, line, {any_snippet(20, 4)} AS near, {any_snippet(30, 2)} AS wide FROM spans"
    mask = "CASE WHEN word = '' THEN repeat({0}, 3) ELSE concat(repeat({0}, length(word) - greatest(1, cast(floor(length(word) * cast({1} AS DOUBLE)) AS BIGINT))), right(word, greatest(1, cast(floor(length(word) * cast({1} AS DOUBLE)) AS BIGINT)))) END"
    o["sca9_mask_value"] = f"""WITH {LINES}, {WORDS} SELECT word, {mask.format("'*'", 0.2)} AS masked, {mask.format("'#'", 0.5)} AS half FROM words"""
    o["sca10_env_preview"] = f"WITH {LINES}, {WORDS} SELECT word, CASE WHEN length(word) > 8 THEN concat(left(word, 4), '...', right(word, 4)) ELSE '***' END AS preview FROM words"
    o["sca11_env_var_name"] = f"""{FOUND} SELECT rule, n, {env_name('rule', 'n')} AS name FROM (
      SELECT rule, cast(line % 5 AS INTEGER) AS n FROM found UNION SELECT concat(event_type, '-url x'), 0 FROM events) x"""
    o["sca12_extract_literal"] = f"WITH {LINES} SELECT * FROM (SELECT path, line, {literal()} AS literal FROM lines) x WHERE literal IS NOT NULL"
    o["sca13_file_kind"] = f"WITH {FILES} SELECT path, {KIND} AS kind FROM ({parted()}) x"
    o["sca14_is_placeholder"] = f"""WITH {LINES}, {WORDS} SELECT word, word IN ('', {q(remediate.ASK)}, {q(remediate.MASKED)}) OR starts_with(word, '***') AS placeholder FROM (
      SELECT word FROM words UNION SELECT {masked('word')} FROM words
      UNION SELECT CASE WHEN length(word) % 2 = 0 THEN {q(remediate.ASK)} ELSE {q(remediate.MASKED)} END FROM words) x"""
    o["sca15_default_snippet"] = f"{FOUND} SELECT {PLACE}, CASE WHEN line % 2 = 1 THEN snippet WHEN token = '' THEN '' ELSE {masked('token')} END AS snippet FROM found"
    o["sca16_remediation_text"] = f"{FOUND} SELECT {PLACE}, {advice()} AS remediation FROM {named}"

    o["rem1_migration_plan"] = f"{PLAN} SELECT path, line, rule, env_var_name, snippet AS value_redacted, {q(remediate.ASK)} AS value_full, round(confidence, 9) AS confidence FROM plan"
    o["rem2_instructions"] = f"""{PLAN} SELECT path, line, "column", env_var_name, concat(env_var_name, chr(10), '   at ', path, ':', cast(line AS VARCHAR), chr(10), '   found by ', rule, chr(10), '   shown as ', snippet) AS instruction FROM plan"""
    # Blocks cut to their last two lines have neither name nor place, and no rule where a value was filled in.
    o["rem3_parse_instructions"] = f"""{PLAN}, twice AS (SELECT * FROM plan UNION ALL SELECT * FROM plan WHERE line % 7 = 3),
      told AS (SELECT CASE WHEN line % 13 <> 4 THEN env_var_name END AS env_var_name, line % 11 <> 2 AND line % 13 <> 4 AS placed, path, line,
        CASE WHEN line % 13 <> 4 OR line % 3 <> 1 THEN rule END AS rule,
        CASE WHEN line % 3 = 1 THEN concat('given: ', line) ELSE {q(remediate.ASK)} END AS value_full FROM twice)
      SELECT env_var_name, CASE WHEN placed THEN path END AS path, CASE WHEN placed THEN line END AS line, rule, value_full,
        CASE WHEN env_var_name IS NULL THEN {q(remediate.NO_NAME)} WHEN NOT placed THEN {q(remediate.NO_PLACE)}
          WHEN line % 7 = 3 THEN {q(remediate.TWICE)} END AS problem FROM told"""
    o["rem4_rewrite_python"] = f"WITH {FILES}, {KNOWN} SELECT path, {with_import(PY_SWAP)} AS text FROM known WHERE kind = 'python'"
    o["rem5_rewrite_js"] = f"WITH {FILES}, {KNOWN} SELECT path, {JS_SWAP} AS text FROM known"
    o["rem6_rewrite_generic"] = f"WITH {FILES}, {KNOWN} SELECT path, {ANY_SWAP} AS text FROM known"
    o["rem7_rewrite_file"] = f"""WITH {FILES}, {KNOWN} SELECT path, CASE WHEN length(text) % 5 = 4 THEN text ELSE {SWAPPED} END AS text_after,
      length(text) % 5 <> 4 AS success, CASE WHEN length(text) % 5 = 4 THEN {q(remediate.NOT_FOUND)} END AS error FROM known"""
    o["rem8_rewrite_many"] = f"WITH RECURSIVE {MANY} SELECT path, {IMPORTED} AS text_after, replaced, outcomes FROM r"
    # A value over two lines makes one line of its two; every key else has one line before and after.
    o["rem9_joined_lines"] = f"""WITH RECURSIVE {MANY},
      put AS (SELECT k.path, k.j, string_split(k.line, chr(10)) AS before, 2 + n + k.j AS new, 2 + n + k.j + (k.j + 3) // 10 AS old
        FROM keys k JOIN (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents) d ON d.doc_id = k.id),
      made AS (SELECT path, unnest(string_split(text, chr(10))) AS after, generate_subscripts(string_split(text, chr(10)), 1) AS new FROM r)
      SELECT path, cast(old AS INTEGER) AS line, before[1] AS before, after FROM put JOIN made USING (path, new) WHERE before[1] <> after
      UNION ALL SELECT path, cast(old + 1 AS INTEGER), before[2], NULL FROM put WHERE len(before) = 2
      UNION ALL SELECT path, 2, NULL, 'import os' FROM (SELECT path, text, {IMPORTED} AS imported FROM r) i WHERE imported <> text"""
    swapped_line = f"CASE kind WHEN 'python' THEN {PY_SWAP} WHEN 'javascript' THEN {JS_SWAP} ELSE {ANY_SWAP} END".replace("text,", "content,")
    o["rem9_changed_lines"] = f"""WITH {FILES}, {KNOWN}, l AS ({lines_of('known', 'path, kind, v')})
      SELECT path, line, content AS before, after FROM (SELECT *, {swapped_line} AS after FROM l) x WHERE content <> after
      UNION ALL SELECT path, 6, NULL, 'import os' FROM known WHERE kind = 'python'"""

    touched = "changed AS (SELECT path, concat(text, chr(10), '# edited') AS text FROM files WHERE contains(text, 'AKIA'))"
    o["str1_incremental_scan"] = f"WITH {FILES}, {touched}, {found_in('changed', excluded_walk())} SELECT {SHOWN} FROM found"
    o["str2_stream_gate"] = o["agg8_gate"]
    return o

"""Inputs for the registered queries, derived from the given tables.

The tables hold almost no credentials, so every row gets lines with made-up
ones that follow from its key by hashing.  The statements below are read by
Spark and, for the comparison, by DuckDB; only two function names differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

SPARK = {
    "sha": "sha2({0}, 256)",
    "b64": "base64(unhex({0}))",
    "numbers": "explode(sequence(1, {0}))",
    "lines": "array_join(transform(array_sort(collect_list(struct(j, line))), x -> x.line), chr(10))",
}
DUCKDB = {
    "sha": "sha256({0})",
    "b64": "to_base64(unhex({0}))",
    "numbers": "unnest(generate_series(1, {0}))",
    "lines": "string_agg(line, chr(10) ORDER BY j)",
}

# One line per rule, in catalogue order, from hash texts: h is 64 hex digits,
# u the same in upper case, a is 44 mixed letters and digits, l 64 letters.
PLANTED = [
    "concat('aws id AKIA', substring(u, 1, 16), ' and AKIA', substring(u, 17, 16))",
    "concat('aws_secret_access = \"', substring(a, 1, 40), '\"')",
    "concat('sk-', substring(h, 1, 48))",
    "concat('xoxb-', substring(h, 1, 12), '-', substring(a, 1, 24))",
    "concat('https://hooks.slack.com/services/T', substring(u, 1, 8), '/B', substring(u, 9, 8), '/', substring(u, 17, 24))",
    "concat('bot M', substring(a, 1, 23), '.', substring(h, 1, 6), '.', substring(a, 10, 27))",
    "concat('https://discord.com/api/webhooks/', cast(id + 100000 as string), '/', a)",
    "concat('ghp_', substring(a, 1, 36))",
    "concat('gho_', substring(a, 1, 36))",
    "concat('eyJ', substring(a, 1, 20), '.eyJ', substring(a, 5, 30), '.', substring(a, 1, 43))",
    "concat('-----BEGIN ', CASE id % 4 WHEN 0 THEN 'RSA' WHEN 1 THEN 'EC' WHEN 2 THEN 'OPENSSH' ELSE 'DSA' END, ' PRIVATE KEY-----')",
    "concat('AIza', substring(a, 1, 35))",
    "concat('sk_live_', substring(a, 1, 24))",
    "concat('rk_live_', substring(a, 1, 24))",
    "concat('SK', substring(h, 1, 32))",
    "concat('AC', substring(h, 1, 32))",
    "concat('maps AIza', substring(a, 1, 35))",
    "concat('api_key: \"', substring(a, 1, 32), '\"')",
    "concat('password = \"', substring(a, 1, 12), '!\"')",
    "concat('postgres://app:', substring(a, 1, 10), '@db.example.org/main')",
    "concat('token=', substring(a, 1, 40))",
    "concat('aws_session_token = \"', h, h, '\"')",
    "concat('Ab17Q~', substring(a, 1, 34))",
    "concat('ya29.', a)",
    "concat('dop_v1_', h)",
    "concat('sk-ant-api03-', h, substring(h, 1, 29), 'AA')",
    "concat('hf_', substring(l, 1, 34))",
    "concat('cohere_key = \"', substring(a, 1, 40), '\"')",
    "concat('r8_', substring(a, 1, 40))",
    "concat('eyJ', substring(h, 1, 20), '.eyJ', substring(h, 5, 30))",
    "concat('vercel_token = \"', substring(a, 1, 24), '\"')",
    "concat('pscale_tkn_', substring(a, 1, 43))",
    "concat('sq0atp-', substring(a, 1, 22))",
    "concat('SG.', substring(a, 1, 22), '.', substring(a, 2, 43))",
    "concat('npm_', substring(a, 1, 36))",
    "concat('pypi-AgEIcH', a, substring(a, 1, 16))",
    "concat('dckr_pat_', substring(a, 1, 40))",
    "concat(substring(a, 1, 14), '.atlasv1.', a, substring(a, 1, 22))",
    "concat('NRAK-', substring(u, 1, 27))",
    "concat('https://', substring(h, 1, 32), '@o', cast(id + 1000 as string), '.ingest.sentry.io/', cast(id + 1 as string))",
    "concat('github_pat_', a, substring(a, 1, 38))",
    "concat('glpat-', substring(a, 1, 20))",
]

# File names, chosen by key: plain, suspicious and excluded ones.
NAMES = [
    "main.py",
    "app.js",
    "conf.yaml",
    ".env",
    "id_rsa",
    "server.PEM",
    "my_Token_list.txt",
    "node_modules/a/b.js",
    "x.min.js",
    "notes.md",
    "service-account.json",
    "tool.ts",
    "lib.py",
]


def _case(subject: str, values: list[str], default: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {subject} {whens} ELSE {default} END"


def _hashed(source: str, key: str, extra: str, dialect: dict[str, str]) -> str:
    """Rows of ``source`` with the hash texts of their key."""
    sha = dialect["sha"].format(f"concat('k', cast({key} as string))")
    b64 = dialect["b64"].format("h")
    return f"""
    SELECT *, translate(b, '+/=', 'xyz') AS a
    FROM (
      SELECT *, upper(h) AS u, translate(h, '0123456789', 'ghijklmnop') AS l, {b64} AS b
      FROM (SELECT {key} AS id, {extra}, {sha} AS h FROM {source}) keyed
    ) hashed"""


def planted_line() -> str:
    return _case(f"id % {len(PLANTED) + 1}", PLANTED, "'nothing here'")


def files_sql(source: str, dialect: dict[str, str]) -> str:
    """``files(id, path, text)``: a document with planted lines, under a path."""
    name = _case(f"id % {len(NAMES)}", [f"'{n}'" for n in NAMES], "'plain.txt'")
    return f"""
    SELECT id,
      concat('src/', origin, '/d', cast(id as string), '/', name) AS path,
      concat(
        CASE WHEN name LIKE '%.py'
          THEN concat('\"\"\"One line.\"\"\"', chr(10), '# note', chr(10), 'import sys', chr(10), 'from re import (', chr(10), '  sub)', chr(10))
          ELSE '' END,
        body, chr(10), planted, chr(10), 'K = \"', a, '\"', chr(10), 'blob ', b, ' ', b) AS text
    FROM (
      SELECT *, {name} AS name, {planted_line()} AS planted
      FROM ({_hashed(source, "doc_id", "source AS origin, text AS body", dialect)}) x
    ) y"""


def keys_sql(source: str, dialect: dict[str, str]) -> str:
    """``keys(id, path, j, env_var_name, value, line)``: 1, 2, 5, 20 or 2,000 values to a file, and the text line that holds each.

    By j modulo 10: 0 is not in the text, 2 has no quotes, 4 holds the value
    before it, 5 has marks, 6 spans lines, 8 holds the value after it.
    """
    sha = dialect["sha"].format("concat('m', cast(id as string), '.', cast({0} as string))")
    last, this, after = (f"substring({sha.format(f'(j + {x})')}, 1, 16)" for x in (-1, 0, 1))
    kind = "CASE id % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'ts' ELSE 'yaml' END"
    quote = "CASE j % 3 WHEN 0 THEN '\"' WHEN 1 THEN chr(39) ELSE CASE id % 3 WHEN 1 THEN '`' ELSE '\"' END END"
    long = "CASE id % 3 WHEN 0 THEN '\"\"\"' ELSE '`' END"
    many = "CASE WHEN id % 500 = 3 THEN 2000 ELSE CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 20 ELSE 5 END END"
    return f"""
    SELECT id, path, j, concat('KEY_', cast(j as string)) AS env_var_name, value,
      CASE WHEN j % 10 = 0 THEN concat('k', cast(j as string), ' = none')
           WHEN j % 10 = 2 THEN concat('k', cast(j as string), ': ', value)
           WHEN j % 10 = 6 THEN concat('k', cast(j as string), ' = ', {long}, value, {long}, '; # and')
           WHEN j % 7 = 3 AND id % 3 = 0 THEN concat('k', cast(j as string), ' = f', quote, value, quote, ' + ', value)
           ELSE concat('k', cast(j as string), ' = ', quote, value, quote) END AS line
    FROM (
      SELECT id, path, j, {quote} AS quote,
        CASE j % 10 WHEN 4 THEN concat({last}, 'x') WHEN 5 THEN concat({this}, '-+.$(') WHEN 6 THEN concat({this}, chr(10), 'more ', {this})
          WHEN 8 THEN concat({after}, 'y') ELSE {this} END AS value
      FROM (
        SELECT id, concat('many/d', cast(id as string), '.', {kind}) AS path, {dialect["numbers"].format(many)} AS j
        FROM (SELECT doc_id AS id FROM {source}) d
      ) n
    ) v"""


def many_sql(source: str, keys: str, dialect: dict[str, str]) -> str:
    """``many(path, text)``: documents with the lines of all their keys."""
    return f"""
    SELECT path, concat('import sys', chr(10), 'run = 1', chr(10), body, chr(10), planted, chr(10), 'end') AS text
    FROM (SELECT id, path, {dialect["lines"]} AS planted FROM {keys} GROUP BY id, path) k JOIN (SELECT doc_id, text AS body FROM {source}) d ON d.doc_id = k.id"""


def diffs_sql(source: str, dialect: dict[str, str]) -> str:
    """``commit_diffs``: a conversation is a commit and a turn one diff."""
    sha = dialect["sha"].format("concat('commit', cast(id as string))")
    return f"""
    SELECT substring({sha}, 1, 40) AS sha, cast(turn as int) AS diff_ord,
      concat('old/', role, cast(turn % 3 as string), '.txt') AS a_path,
      CASE WHEN turn % 4 = 1 THEN '' ELSE concat('new/', role, cast(turn % 3 as string), '.txt') END AS b_path,
      turn % 6 = 5 AS deleted,
      concat('diff --git a/x b/x', chr(10), 'index 1..2', chr(10), '--- a/x', chr(10), '+++ b/x', chr(10),
        '@@ -1,2 +', cast(turn * 10 + 3 as string), ',9 @@ first', chr(10),
        ' context', chr(10), '-gone', chr(10),
        '+', replace(body, chr(10), concat(chr(10), '+')), chr(10),
        '+', planted, chr(10),
        '@@ -40 +90 @@ again', chr(10),
        '+++ lost', chr(10), ' kept', chr(10), '+blob ', b, ' ', b, chr(10),
        '+', planted, chr(10),
        chr(92), ' No newline at end of file') AS patch
    FROM (
      SELECT *, {planted_line()} AS planted
      FROM ({_hashed(source, "conv_id", "turn, role, text AS body", dialect)}) x
    ) y"""


def commits_sql(source: str, dialect: dict[str, str], array: str) -> str:
    """``commits``: a line of commits with forks and merges."""

    def sha(n: str) -> str:
        return f"substring({dialect['sha'].format(f'''concat('commit', cast({n} as string))''')}, 1, 40)"

    first = "CASE WHEN id % 10 = 4 THEN id - 3 ELSE id - 1 END"
    one, two = sha(f"({first})"), sha("(id - 4)")
    return f"""
    SELECT id, {sha("id")} AS sha,
      CASE WHEN id = 0 THEN {array.format(one).replace(one, "")}
           WHEN id % 10 = 7 THEN {array.format(f"{one}, {two}")}
           ELSE {array.format(one)} END AS parents,
      concat('Dev ', cast(id % 7 as string)) AS author_name,
      concat('dev', cast(id % 7 as string), '@example.org') AS author_email,
      cast(1700000000 + id * 3600 as bigint) AS committed_at,
      concat(chr(10), '  ', body, ' ', chr(10)) AS message
    FROM (SELECT conv_id AS id, text AS body FROM {source} WHERE turn = 0) x"""


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return spark.sql(files_sql("{documents}", SPARK), documents=docs).select("path", "text")


def documents_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, whether the table is one file or a folder of part files."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # A stream takes no path of a single file, but a pattern may stand for a file and for a folder alike.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")


def many(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files with up to 2,000 values each, and the plan that replaces them: ``path, text`` and ``path, line, env_var_name, value_full``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    keys = spark.sql(keys_sql("{documents}", SPARK), documents=docs)
    files = spark.sql(many_sql("{documents}", "{keys}", SPARK), documents=docs, keys=keys)
    return files, keys.selectExpr("path", "j AS line", "env_var_name", "value AS value_full")


def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: the files as bytes, some with what a decoder has to cope with.

    By key modulo 8: 1 has CRLF line ends, 2 bytes that are no UTF-8 at the
    end, 3 is binary by a NUL in front, 4 has a NUL beyond where binary files
    are told.
    """
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    made = spark.sql(files_sql("{documents}", SPARK), documents=docs)
    kind, raw = F.col("id") % 8, F.col("text").cast("binary")
    content = (
        F.when(kind == 1, F.replace("text", F.lit("\n"), F.lit("\r\n")).cast("binary"))
        .when(kind == 2, F.concat(raw, F.unhex(F.lit("0AFFFE"))))
        .when(kind == 3, F.concat(F.unhex(F.lit("00")), raw))
        .when(kind == 4, F.concat(raw, F.lit("\n" + " " * 8192).cast("binary"), F.unhex(F.lit("00"))))
        .otherwise(raw)
    )
    return made.select("path", content.alias("content"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spread(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return spark.sql(diffs_sql("{conversations}", SPARK), conversations=talk)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    text = commits_sql("{conversations}", SPARK, "array({0})")
    text = text.replace("array()", "cast(array() as array<string>)")
    return spark.sql(text, conversations=talk).drop("id")


def pages_sql(source: str, dialect: dict[str, str]) -> str:
    """Web pages under their addresses, with a planted comment and script."""
    return f"""
    SELECT concat(url, '#', cast(id as string), CASE WHEN id % 6 = 2 THEN '/private.html' ELSE '/page.html' END) AS path,
      concat(html, chr(10), '<!-- ', planted, ' -->', chr(10),
        '<script src="https://cdn.example.org/', a, '.js"></script>', chr(10), '<p>', b, '</p>') AS text
    FROM (SELECT *, {planted_line()} AS planted FROM ({_hashed(source, "page_id", "url, html", dialect)}) x) y"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = spread(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return spark.sql(pages_sql("{pages}", SPARK), pages=web)

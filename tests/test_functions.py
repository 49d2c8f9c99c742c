import math
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from plain import entropy
from veilscan.functions import entropy as E
from veilscan.functions import naming, paths, redact, text as T
from veilscan.functions.report import confidence_band, confidence_level, confidence_text
from veilscan.options import SKIP_GLOBS, SKIP_GLOBS_SETTINGS, ScanOptions


def apply(spark, values, *columns, schema="v string"):
    """The expressions for each value, in order."""
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], f"i int, {schema}")
    rows = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]




def test_entropy_known_values(spark):
    values = ["", "aaaaaaa", "ababab", "abcdefgh", "hello", "0123456789abcdef" * 2, "漢字漢字é"]
    got = apply(spark, values, E.shannon_entropy(F.col("v")))
    assert got == pytest.approx([0, 0, 1, 3, 1.9219280948873623, 4.0, entropy("漢字漢字é")], abs=1e-12)
    assert got[5] == 4.0


def test_is_high_entropy_gate(spark):
    got = apply(spark, ["", "abcdefgh", "a" * 20, "0123456789abcdef" * 2], E.is_high_entropy(F.col("v")))
    assert [tuple(r) for r in got] == [(False, 0.0), (False, 0.0), (False, 0.0), (True, 4.0)]
    assert tuple(apply(spark, ["a" * 20], E.is_high_entropy(F.col("v"), 0.0))[0]) == (True, 0.0)


def test_extract_tokens_lengths(spark):
    mixed = "abcdefghijklmnopqrstuvwxyz0123456789"
    line = f"key={mixed} {'x' + mixed * 6} {mixed[:19]} {mixed[:20]}"
    (got,) = apply(spark, [line], E.extract_tokens(F.col("v")))
    assert [(t["token"], t["start"], t["end"]) for t in got] == [
        (f"key={mixed}", 0, 40),
        (mixed[:20], len(line) - 20, len(line)),
    ]


def test_allowlist(spark):
    got = apply(spark, ["xxYOUR_API_KEY_HERExx", "iVBORw0KGgoAAAANSUhEUgAA1", "none"], E.is_allowlisted(F.col("v")))
    assert got == [True, True, False]


def test_entropy_confidence_is_capped(spark):
    assert apply(spark, [4.0, 7.9], E.entropy_confidence(F.col("v")), schema="v double") == [0.5, 0.95]


def test_redaction(spark):
    assert apply(spark, ["abcdefgh", "abcd", "", "漢字漢字漢"], redact.redact_secret(F.col("v"))) == ["***efgh", "***", "***", "***字漢字漢"]
    assert apply(spark, ["abcdefghij", "x", "", "12345678901"], redact.mask_value(F.col("v"))) == ["********ij", "x", "***", "*********01"]
    assert apply(spark, ["12345678", "123456789"], redact.env_preview(F.col("v"))) == ["***", "1234...6789"]
    spans = [("hello secret end", 6, 12), ("abc", 2, 9), ("abc", 2, 2), ("abc", -1, 2)]
    s, e = F.col("s"), F.col("e")
    got = apply(spark, spans, redact.redact_line(F.col("v"), s, e), schema="v string, s int, e int")
    assert got == ["hello ***cret end", "abc", "abc", "abc"]


def test_snippets(spark):
    line = "a" * 30 + "SECRETVALUE" + "b" * 30
    s, e = F.col("s"), F.col("e")
    got = apply(
        spark,
        [(line, 30, 41), ("SECRETVALUE", 0, 11), (line, 30, 99)],
        redact.create_snippet(F.col("v"), s, e, 5),
        redact.redact_snippet(F.col("v"), s, e, 5),
        schema="v string, s int, e int",
    )
    assert got[0] == ("...aaaaaSECRETVALUEbbbbb...", "...aaaaa***ALUEbbbbb...")
    assert got[1] == ("SECRETVALUE", "***ALUE")
    assert got[2][1].startswith("...aaaaaSECRET")


def test_default_snippet(spark):
    got = apply(spark, [("tokentoken", None), ("tokentoken", ""), ("tokentoken", "shown")], redact.default_snippet(F.col("v"), F.col("s")), schema="v string, s string")
    assert got == ["***oken", "***oken", "shown"]


def test_filenames(spark):
    cases = {
        ".env": ("SUSPICIOUS_FILENAME", 0.95),
        "id_rsa": ("SUSPICIOUS_FILENAME", 0.99),
        "x.pem": ("SUSPICIOUS_EXTENSION", 0.90),
        "x.PEM": ("SUSPICIOUS_EXTENSION", 0.90),
        "SECRET.txt": ("SUSPICIOUS_PATTERN", 0.75),
        "secret.key": ("SUSPICIOUS_EXTENSION", 0.85),
        "secret_password.txt": ("SUSPICIOUS_PATTERN", 0.75),
        "/home/user/config/.env": ("SUSPICIOUS_FILENAME", 0.95),
        ".ENV": None,
        ".env.example": None,
        ".pem": None,
        "a.pem.": None,
        "private/readme.md": None,
    }
    got = apply(spark, list(cases), paths.filename_finding(F.col("v")), paths.suspicious_name(F.col("v")))
    assert [None if f is None else (f["rule"], f["confidence"]) for f, _ in got] == list(cases.values())
    assert [s for _, s in got] == [c is not None for c in cases.values()]


def test_file_warning(spark):
    got = apply(spark, ["id_rsa", "a.txt"], paths.file_warning(F.col("v")))
    assert got == [f"WARNING: {paths.NAME_REASON % 'id_rsa'} (confidence: 99%)", None]


def test_suffix_and_kind(spark):
    names = ["a.py", "a.PY", "d/x.min.js", ".env", "a.", "..b", "noext", "a.tsx", "a b.cjs"]
    got = apply(spark, names, paths.file_suffix(F.col("v")), paths.file_kind(F.col("v")))
    # Newer Python versions changed the suffix of "a."; the rule here is the older one.
    want = [PurePosixPath(n).suffix if not n.endswith(".") else "" for n in names]
    assert [g[0] for g in got] == want
    assert [g[1] for g in got] == ["python", "python", "javascript", "other", "other", "other", "other", "javascript", "javascript"]


PATHS = [
    "node_modules/package.json",
    "node_modules/a/b.js",
    "src/node_modules.py",
    "a/x.min.js",
    "package-lock.json",
    "yarn.lock",
    "x.lock/inner.txt",
    "path/test/file.py",
    "deep/.venv/lib/python/site.py",
    "foo.egg-info/PKG",
    "pkg/.coverage.xml",
    "env/readme",
    "myenv/readme",
    ".git/config",
    "a/b/build/c",
    "/abs/dist/x",
    "build",
]


def test_exclude_exact_equals_path_match(spark):
    globs = [*SKIP_GLOBS_SETTINGS, "a/*/build/*", "[xy].lo?k", "[!a-c]*.py", "/abs/**/x"]
    got = apply(spark, PATHS, paths.exclude_exact(F.col("v"), globs))
    want = [any(PurePosixPath(p).match(g) if "*" in g else g in p for g in globs) for p in PATHS]
    assert got == want


def test_exclude_walk_prunes_directories(spark):
    def walk(p, globs):
        parts = PurePosixPath(p)
        return any(
            any(q.match(g) if "*" in g else g in str(q) for g in globs) for q in [parts, *parts.parents] if str(q) not in (".", "/")
        )

    got = apply(spark, PATHS, paths.exclude_walk(F.col("v")))
    assert got == [walk(p, SKIP_GLOBS) for p in PATHS]
    assert got[1] and not got[2] and not got[4]


def test_walk_root_bounds_the_match(spark):
    rooted = ["/x/node_modules/a/b.js", "/x/node_modules/src/y.map"]
    assert apply(spark, rooted, paths.exclude_walk(F.col("v"), root="/x/node_modules")) == [True, True]
    assert apply(spark, rooted, paths.exclude_walk(F.col("v"), ["x/**"], root="/x/node_modules")) == [False, False]
    assert apply(spark, rooted, paths.exclude_walk(F.col("v"), ["*.map"], root="/x/node_modules/")) == [False, True]


def test_exclude_lists(spark):
    assert apply(spark, ["path/test/file.py"], paths.exclude_exact(F.col("v"), ["test"]), paths.exclude_exact(F.col("v"), [])) == [(True, False)]
    assert ScanOptions(exclude_patterns=()).exclude_patterns == tuple(SKIP_GLOBS)
    assert len(SKIP_GLOBS) == 23 and len(SKIP_GLOBS_SETTINGS) == 25


@pytest.mark.parametrize("bad", [{"entropy_threshold": 9}, {"min_token_length": 0}, {"confidence_threshold": -0.1}, {"history_depth": 0}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        ScanOptions(**bad)


def test_binary(spark):
    cases = [
        (b"abc\x00", True),
        (b"", False),
        (bytes(range(1, 32)) * 3, True),
        (b"\t\n\r" * 50, False),
        (b"a" * 8192 + b"\x00", False),
        (None, True),
        (b"\x01" * 3 + b"a" * 7, False),
        (b"\x01" * 4 + b"a" * 6, True),
        ("é".encode() * 5000 + b"\x00", False),
        ("é".encode() * 4095 + b"\x00", True),
    ]
    got = apply(spark, [(c[0],) for c in cases], T.is_binary(F.col("v")), schema="v binary")
    assert got == [want for _, want in cases]
    texts = [(c[0].decode(),) if c[0] is not None else (None,) for c in cases]
    assert apply(spark, texts, T.is_binary_text(F.col("v"))) == [want for _, want in cases]


def test_decoding(spark):
    raw = [b"ok\xffbad\xc3", "keep � é".encode(), b"a\r\nb\rc\n"]
    got = apply(spark, [(r,) for r in raw], T.universal_newlines(T.decode_utf8(F.col("v"))), schema="v binary")
    assert got == [r.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n") for r in raw]


def test_lines_are_numbered(spark):
    df = spark.createDataFrame([("p", "a\n\nb\n")], "path string, text string")
    got = sorted((r["line"], r["content"]) for r in T.lines(df, start_line=100).collect())
    assert got == [(100, "a"), (101, ""), (102, "b"), (103, "")]


def test_secret_exposed(spark):
    lines = ["PASSWORD = x", "password x", "nothing=1", "my Api_Key: y"]
    assert apply(spark, lines, T.secret_exposed(F.col("v"))) == [True, False, False, True]
    assert apply(spark, lines, T.secret_exposed(F.col("v"), ["nothing"])) == [False, False, True, False]


def test_env_names(spark):
    cases = [
        ("AWS_ACCESS_KEY", 0, "AWS_ACCESS_KEY_ID"),
        ("AWS_ACCESS_KEY", 1, "AWS_ACCESS_KEY_ID_2"),
        ("HIGH_ENTROPY", 0, "HIGH_ENTROPY_KEY"),
        ("GITHUB_PAT", 0, "GITHUB_PAT_KEY"),
        ("GENERIC_SECRET", 0, "GENERIC_SECRET"),
        ("SENTRY_DSN", 2, "SENTRY_DSN_KEY_3"),
        ("slack-webhook", 0, "SLACK_WEBHOOK_URL"),
        ("my rule", 0, "MY_RULE_KEY"),
    ]
    got = apply(spark, [(r, n) for r, n, _ in cases], naming.env_var_name(F.col("v"), F.col("n")), schema="v string, n int")
    assert got == [w for *_, w in cases]
    assert [naming.default_env_name(r) for r, n, _ in cases if n == 0] == [w for _, n, w in cases if n == 0]


def test_bands(spark):
    got = apply(spark, [0.95, 0.8, 0.75, 0.5, 0.3], confidence_band(F.col("v")), confidence_level(F.col("v")), confidence_text(F.col("v")), schema="v double")
    assert [g[0] for g in got] == ["high", "high", "medium", "medium", "low"]
    assert [g[1] for g in got] == ["critical", "high", "medium", "low", "low"]
    assert got[0][2] == "0.95 strong" and got[2][2] == "0.75 warning" and got[4][2] == "0.30 info"


def test_entropy_advice_rounds_half_even(spark):
    (text,) = apply(spark, [4.125], E.entropy_advice(F.col("v")), schema="v double")
    assert "4.12 bits" in text and f"{4.125:.2f}" == "4.12" and math.log2(16) == 4

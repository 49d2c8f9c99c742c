import random
import re

import pytest
from pyspark.sql import functions as F

from samples import matches, random_lines
from veilscan.functions.regexes import java_pattern, token_group
from veilscan.operators.detect import scan_lines, scan_patterns
from veilscan.rules import CATALOGUE, RuleSet, drop_builtin_marks
from plain import entropy_matches, rule_matches

RULES = RuleSet.default()


def lines_df(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "id int, content string")


def hits(df):
    return sorted((r["id"], r["rule"], r["token"], r["start"], r["end"]) for r in df.collect())


def test_catalogue_size_and_order():
    assert len(CATALOGUE) == 42
    assert RULES.names()[0] == "AWS_ACCESS_KEY" and RULES.names()[-1] == "GITLAB_PAT"
    assert RULES.info("PRIVATE_KEY").group == 1 and RULES.info("GENERIC_SECRET").group == 2
    assert RULES.info("nothing") is None
    assert all(re.compile(r.pattern).groups == r.group for r in RULES.rules)


def test_each_rule_hits_its_sample(spark):
    texts = matches(random.Random(1))
    assert set(texts) == set(RULES.names())
    found = scan_patterns(lines_df(spark, list(texts.values()))).select("id", "rule").collect()
    pairs = {(r["id"], r["rule"]) for r in found}
    assert all((i, name) in pairs for i, name in enumerate(texts))


def test_each_rule_misses_a_cut_sample(spark):
    """Each sample shortened below the least length, or with a wrong first letter."""
    texts = matches(random.Random(2))
    cut = []
    for name, text in texts.items():
        keep = {"SLACK_TOKEN": 5, "SLACK_WEBHOOK": 33, "JWT_TOKEN": 24, "SUPABASE_SERVICE_KEY": 24}
        cut.append(text[: keep.get(name, len(text) - 6)] if name not in ("GCP_OAUTH_TOKEN", "DATABASE_URL") else text[:-1])
    df = lines_df(spark, cut)
    found = {(r["id"], r["rule"]) for r in scan_patterns(df).select("id", "rule").collect()}
    loose = {"DISCORD_WEBHOOK", "SENTRY_DSN", "GCP_OAUTH_TOKEN"}
    for i, name in enumerate(texts):
        if name not in loose:
            assert ((i, name) in found) == any(r[0] == name for r in rule_matches(cut[i])), name


def test_native_plan_equals_python_on_random_lines(spark):
    lines = random_lines(7, 1500)
    expected = sorted((i, *m) for i, line in enumerate(lines) for m in rule_matches(line))
    assert hits(scan_patterns(lines_df(spark, lines))) == expected
    assert {e[1] for e in expected} == set(RULES.names())


def test_shortcuts_lose_nothing(spark):
    lines = random_lines(8, 1500)
    df = lines_df(spark, lines)
    assert hits(scan_patterns(df)) == hits(scan_patterns(df, rules=drop_builtin_marks(RULES)))
    gated = df.where(RULES.may_match(F.col("content"))).select("id").collect()
    needed = {i for i, line in enumerate(lines) if rule_matches(line)}
    assert needed <= {r["id"] for r in gated}


@pytest.mark.parametrize("folded", ["ſ", "K", "ı", "İ"])
def test_case_folding_agrees(spark, folded):
    plain = {"ſ": "s", "K": "k", "ı": "i", "İ": "i"}[folded]
    lines = [t.replace(plain, folded) for t in matches(random.Random(3)).values()]
    expected = sorted((i, *m) for i, line in enumerate(lines) for m in rule_matches(line))
    assert hits(scan_patterns(lines_df(spark, lines))) == expected


def test_classes_agree_with_python_for_every_character(spark):
    """\\s, \\d, \\w and the folded letter classes over the whole BMP."""
    chars = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    df = lines_df(spark, chars)
    # Letters and digits newer than the Java runtime's tables may differ.
    import unicodedata

    for p, tolerance in [(r"\s", 0), (r"\d", 60), (r"\w", 6000), (r"(?i)[a-z]", 0), (r"(?i)s", 0), (r"(?i)k", 0), (r"(?i)i", 0)]:
        got = {r["id"] for r in df.where(F.col("content").rlike(java_pattern(p))).select("id").collect()}
        want = {i for i, c in enumerate(chars) if re.match(p, c)}
        assert len(got ^ want) <= tolerance, (p, [unicodedata.name(chars[i], "?") for i in sorted(got ^ want)[:5]])
        assert not {i for i in got ^ want if i < 0x0700}


def test_user_rules(spark):
    rules = RULES.with_rule("TICKET", r"\bTKT-(\d{4})\b", 0.8, "Close it.")
    assert rules.names()[-1] == "TICKET" and rules.info("TICKET").group == 1
    rows = scan_patterns(lines_df(spark, ["see TKT-1234, TKT-99999 and é TKT-0001"]), rules=rules).collect()
    assert [(r["token"], r["start"], r["end"], r["remediation"]) for r in sorted(rows, key=lambda r: r["start"])] == [
        ("1234", 4, 12, "Close it."),
        ("0001", 30, 38, "Close it."),
    ]
    assert rules.with_rule("TICKET", r"T-\d", 0.5, "x").names() == rules.names()
    behind = RULES.with_rule("AFTER", r"(?<=key=)[a-z]{3}", 0.5, "x")
    rows = scan_lines(lines_df(spark, ["key=abc key=def abc"]), rules=behind).where("rule = 'AFTER'").collect()
    assert sorted(r["column"] for r in rows) == [4, 12]


@pytest.mark.parametrize("bad", ["x*", "(a)|b", "(a)?b", "((a)b)", "(?m)a", "[\\S]a", "("])
def test_unsupported_user_rules_are_refused(bad):
    with pytest.raises((ValueError, re.error)):
        RULES.with_rule("BAD", bad, 0.5, "x")


def test_group_rules():
    assert token_group("ab") == 0 and token_group("(a)(b)") == 2 and token_group("(?:a)(b)") == 1


def test_many_matches_on_one_line(spark):
    """More matches than one block of the offset fold."""
    line = " ".join(f"xoxb-{i}" for i in range(1000))
    rows = scan_patterns(lines_df(spark, [line]), rules=RULES.only(["SLACK_TOKEN"])).collect()
    got = sorted((r["start"], r["token"]) for r in rows)
    assert got == [(m.start(), m.group()) for m in re.finditer(r"xoxb-\d+", line)]


def test_long_line_snippets(spark):
    """Snippets cut from chunks equal those cut from the line."""
    rng = random.Random(5)
    line = "é" * 4000 + "".join(f" ghp_{''.join(rng.choices('abcdef0123', k=36))} 漢字" for _ in range(200))
    rows = scan_lines(lines_df(spark, [line])).where("rule = 'GITHUB_PAT'").collect()
    assert len(rows) == 200
    for r in rows:
        s, e = r["column"], r["end"]
        want = "..." + line[s - 30 : s] + "***" + line[e - 4 : e] + line[e : e + 30] + ("..." if e + 30 < len(line) else "")
        assert r["snippet"] == want


def test_entropy_equals_python_on_random_lines(spark):
    from veilscan.operators.detect import scan_entropy

    lines = random_lines(9, 800)
    expected = sorted((i, t, s, e) for i, line in enumerate(lines) for t, s, e in entropy_matches(line))
    rows = scan_entropy(lines_df(spark, lines)).collect()
    assert sorted((r["id"], r["token"], r["start"], r["end"]) for r in rows) == expected
    assert len(expected) > 100

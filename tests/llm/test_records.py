"""Archives, host rules, languages, personal data, the queries and the pipeline."""

import base64
import gzip
import hashlib
import os
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from veilscan.llm import boosting, hosts, languages, oracle, private, queries, warc
from veilscan.session import scratch_path

from .conftest import ROWS, prose

PAGES = [(i, f"http://x/{i}\r\n", prose(i % 4, 300)) for i in range(12)] + [(50, None, None), (51, "u", ""), (52, "u", "é" * 10), (53, "u", "é" * 10)]
PAGES += [(None, "u", prose(1, 300)), (60, "u", prose(9, 300)), (60, "v", prose(9, 300)), (None, None, prose(10, 300))]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(4)


def test_archives_resolve_revisits(spark, pages):
    got = sorted(map(str, map(tuple, warc.archived(pages).collect())))
    first = {}
    for page_id, _, html in PAGES:
        if len((html or "").encode()) >= 1000 and page_id is not None:
            first[html] = max(first.get(html, -1), page_id)
    want = []
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        revisit = html in first and first[html] != page_id
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None))
    assert got == sorted(map(str, want))
    assert warc.archived(pages.limit(0)).count() == 0


def test_archives_are_plain_gzip_members(spark, pages):
    folder = scratch_path(spark, "warc-test")
    warc.write_archives(warc.resolved(pages), folder).collect()
    raw = b"".join(gzip.decompress(open(f"{folder}/{f}", "rb").read()) for f in sorted(os.listdir(folder)) if f.endswith(".gz"))
    assert not [f for f in os.listdir(folder) if f.endswith(".tmp")]
    assert raw.count(b"WARC/1.1\r\n") == len(PAGES) and raw.count(b"WARC-Type: revisit") == raw.count(b"WARC-Refers-To: ")


def test_few_marks_give_the_same_records(spark, pages, monkeypatch):
    def told():
        return sorted(map(str, map(tuple, warc.resolved(pages).select("page_id", "url", "digest", "refers_to", "revisit").collect())))

    want = told()
    for bits in (1, 5):  # all pages take the way of repeated ones
        monkeypatch.setattr(warc, "MARKS", bits)
        assert told() == want


def test_marks_hold_every_digest_and_few_others(spark):
    every = spark.range(40_000).select(F.sha1(F.col("id").cast("string")).alias("digest"))
    marked = spark.range(20_000).select(F.sha1(F.col("id").cast("string")).alias("digest"))
    rows = warc.with_marks(every.withColumn("mine", F.col("digest").isin([])), marked)
    assert rows.columns == ["digest", "mine", "marked"] and rows.count() == 40_000
    assert rows.join(marked, "digest").where("marked").count() == 20_000
    assert rows.where("marked").count() < 20_100
    assert warc.with_marks(every, marked.limit(0)).where("marked").count() == 0


def test_payloads_are_not_shuffled_by_digest(spark, pages):
    plan = warc.resolved(pages)._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and not [x for x in joins if "Join [digest" in x and "page_id" not in x]


def test_hosts(spark, docs, no_docs):
    got = hosts.judged_by_host(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[3].n_words == by[5].n_words == 0 and by[3].base_failed and not by[3].kept
    words = ROWS[9][1].split()
    assert by[9].n_words == len(words) and by[9].word_chars == sum(map(len, words))
    assert hosts.judged_by_host(no_docs).count() == 0


def test_host_rates_are_shrunk(spark):
    good, bad = prose(1, 200), "x y"
    rows = [(i, good, "fine") for i in range(50)] + [(100 + i, bad, "poor") for i in range(40)] + [(200 + i, good, "poor") for i in range(2)] + [(300, good, None)]
    rows += [(400, bad, "new"), (401, good, "new")]
    rows += [(500 + i, good, f"h{i}") for i in range(20)]
    got = {r.doc_id: r.kept for r in hosts.judged_by_host(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] and got[300] and got[401] and not got[400]
    assert not got[200]  # a good document of a host that fails nearly always


def rates_frame(spark, counts):
    """Hosts of ``(n, failed)``: the documents fail the rule ``short`` and no other."""
    rows = [(f"h{i}", k < failed) for i, (n, failed) in enumerate(counts) for k in range(n)]
    df = spark.createDataFrame(rows, "source string, short boolean")
    return df.withColumns({name: F.lit(False) for name in hosts.rules() if name != "short"})


def test_prior_is_fitted_to_the_counts(spark):
    """Rates drawn from a beta distribution: mean and strength are found again, whatever the sizes of hosts."""
    rnd = random.Random(2)
    for a, b in ((2.0, 6.0), (0.5, 0.5), (12.0, 28.0)):
        counts = []
        for _ in range(1500):
            n, rate = rnd.choice((1, 2, 5, 20, 60)), rnd.betavariate(a, b)
            counts.append((n, sum(rnd.random() < rate for _ in range(n))))
        found = spark.createDataFrame(counts, "n long, short long").withColumns({name: F.lit(0) for name in hosts.rules() if name != "short"})
        mean, like = hosts.priors(found)["short"]
        assert abs(mean - a / (a + b)) < 0.03 and 0.8 < (1 / like - 1) / (a + b) < 1.25
        assert hosts.priors(found)["symbols"] == (0.0, 0.0)


def test_hosts_of_one_document_are_not_condemned_for_it(spark):
    judged = rates_frame(spark, [(1, int(i % 3 == 0)) for i in range(300)])
    rates = hosts.host_rates(judged).collect()
    assert len(rates) == 300 and all(abs(r.short - 1 / 3) < 1e-9 for r in rates)
    assert hosts.with_verdicts(judged, 0.5).where("bad_host").count() == 0
    assert hosts.host_rates(judged.limit(0)).count() == 0


def test_verdicts_reach_documents_of_every_host(spark, monkeypatch):
    """The same rows, hosts joined by broadcast or not; documents without a host and rules that all hosts pass included."""
    judged = rates_frame(spark, [(40, 39), (30, 1), (1, 1), (2, 0), (200, 190), (50, 0)])
    judged = judged.unionByName(judged.limit(7).withColumn("source", F.lit(None).cast("string")))

    def told():
        return sorted(map(str, map(tuple, hosts.with_verdicts(judged, 0.5).select("source", "short", "bad_host").collect())))

    want = told()
    assert len(want) == judged.count() and sum("True)" in x and "h4" in x for x in want) == 200
    assert not [x for x in want if "None" in x and x.endswith("True)")]
    for share in (1, 3):
        monkeypatch.setattr(hosts, "SHARE", share)
        assert told() == want


def test_repeated_words_equal_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice(["a ", "b ", "c\n", "\x1c", "é "]) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    got = {r.doc_id: r for r in hosts.judged_by_host(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))).collect()}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        threes = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        again = {k + j for k, t in enumerate(threes) if threes.count(t) > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_dup_lines) == (len(words), len(again), len(lines) - len(set(lines)))


def test_languages(spark, docs, no_docs, sf):
    got = languages.identified(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und" and by[3].score == 0
    assert by[9].lang_pred != "und" and 0 <= by[9].score <= 1
    assert languages.identified(no_docs).count() == 0
    table = spark.read.parquet(f"{sf}/documents.parquet")
    told = languages.identified(table).join(table.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out AND n_chars > 100")
    right, n = told.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert n > 20 and right / n > 0.97


def test_unlabelled_documents_are_all_unknown(spark):
    got = languages.identified(spark.createDataFrame([(1, "some text")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")))
    assert [r.lang_pred for r in got.collect()] == ["und"]


def test_dense_and_sorted_counting_agree(monkeypatch):
    texts = ["the house", "日本語 テキスト", "", "Ünï cödé the house"]
    one = languages.vectors(texts)
    monkeypatch.setattr(languages, "DENSE_LETTERS", 0)
    monkeypatch.setattr(languages, "BLOCK_GRAMS", 3)
    assert np.allclose(one, languages.vectors(texts))
    assert not one[2].any()


RULES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                kind == 2 and 12 <= len(digits) <= 19 and private.luhn(digits),
                kind == 3 and 9 <= len(digits) <= 15,
            )
            if good[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_plain_spans_equal_the_expressions():
    rnd, found = random.Random(2), 0
    for i in range(20_000):
        text = "".join(rnd.choice("aB1 2.@-+()_%\n0é9.") for _ in range(rnd.randint(0, 50)))
        text = text.replace("a", "4").replace("B", "5") if i % 3 == 0 else text
        assert private.plain_spans(text) == plain(text)
        found += len(plain(text))
    assert found > 200


def test_hostile_texts_take_time_in_proportion():
    begin = time.perf_counter()
    for text in ("a" * 100_000, "1" * 100_000, "1." * 50_000, "1 " * 50_000, "+1" * 50_000, "a@" * 50_000, "+1" + " " * 100_000, "a.b@c" * 20_000, "a.b@c " * 20_000):
        private.spans_of([text], private.Chooser(None, (2.0,) * 4))
        private.proposals(text)
    assert time.perf_counter() - begin < 30


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:1500], y[:1500])
    assert ((boosting.sigmoid(model.margin(x[1500:])) > 0.5) == y[1500:]).mean() > 0.95


@pytest.fixture(scope="module")
def many_private(spark):
    rnd, rows = random.Random(9), []
    for i in range(400):
        digits = [rnd.randrange(10) for _ in range(15)]
        card = next(c for c in ("".join(map(str, digits)) + str(d) for d in range(10)) if private.luhn(c))
        own = (f"{rnd.randrange(99)}@mail{i}.example.com", f"{rnd.randrange(1, 255)}.{rnd.randrange(255)}.7.{i % 255}", card, f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}")
        rows.append((i, f"{prose(i, 8)} {own[i % 4]} {prose(i + 1, 6)} order {rnd.randrange(10**7, 10**9)}"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_boosting_adds_spelled_out_spans(spark, many_private):
    chooser = private.trained(many_private)
    texts = ["write to john.doe at example dot com now", "host 10[.]2[.]33[.]4 is down", "born 1987-05-12 in", "the version 1.2.3 of", "plain words at home. They stay"]
    found = [private.written(every) for _, every in private.spans_of(texts, chooser)]
    assert found[0] == "email:9:36" and found[1] == "ip:5:20" and found[2:] == ["", "", ""]
    rows = {r.doc_id: r for r in private.found(many_private, chooser).collect()}
    for i, text in ((r.doc_id, r.text) for r in many_private.collect()):
        base = plain(text)
        assert rows[i].base_sha256 == hashlib.sha256(private.written(base).encode()).hexdigest()
        # A text without plain spans may have an added one, such as a card after another number.
        assert {private.written([x]) for x in base} <= set(rows[i].spans.split(","))
        assert [rows[i][f"n_{k}"] for k in private.KINDS] == [sum(s[2] == j for s in base) for j in range(4)]


def disguised(kind, rnd):
    """Personal data that no plain rule finds."""
    if kind == 0:
        return f"u{rnd.randrange(9999)} " + rnd.choice(("at mail{0} dot example dot com", "(at) mail{0} (dot) org", "[at]mail{0}[dot]net")).format(rnd.randrange(99))
    if kind == 1:
        return rnd.choice(("[.]", "(.)", "[dot]")).join(str(rnd.randrange(256)) for _ in range(4))
    if kind == 2:
        digits = "4" + "".join(str(rnd.randrange(10)) for _ in range(14))
        card = next(digits + str(d) for d in range(10) if private.luhn(digits + str(d)))
        return rnd.choice("./").join(card[i : i + 4] for i in range(0, 16, 4))
    return rnd.choice(("({}) {}-{}", "{}-{}-{}")).format(rnd.randrange(200, 999), rnd.randrange(200, 999), rnd.randrange(1000, 9999))


def usual(kind, rnd):
    """Personal data that a plain rule finds."""
    if kind == 0:
        return f"u{rnd.randrange(9999)}@mail{rnd.randrange(99)}.example.com"
    if kind == 1:
        return ".".join(str(rnd.randrange(256)) for _ in range(4))
    if kind == 2:
        digits = "5" + "".join(str(rnd.randrange(10)) for _ in range(14))
        return next(digits + str(d) for d in range(10) if private.luhn(digits + str(d)))
    return f"+1 ({rnd.randrange(200, 999)}) {rnd.randrange(200, 999)}-{rnd.randrange(1000, 9999)}"


def test_a_third_of_the_spans_disguised(spark):
    rnd, rows, hidden = random.Random(4), [], []
    for i in range(1500):
        before, after = (re.sub("[0-9]", "", prose(2 * i + k, 7)) for k in (0, 1))
        own = disguised(i % 4, rnd) if i % 3 == 0 else usual(i % 4, rnd)
        if i % 3 == 0:
            hidden.append((f"{before} {own} {after}", (len(before) + 1, len(before) + 1 + len(own), i % 4)))
        rows.append((i, f"{before} {own} {after}"))
    chooser = private.trained(spark.createDataFrame(rows, "doc_id long, text string"))
    found = private.spans_of([t for t, _ in hidden], chooser)
    share = [np.mean([want in every for (_, want), (_, every) in zip(hidden, found, strict=True) if want[2] == k]) for k in range(4)]
    assert min(share) > 0.95, share
    wrong = ["paid 5 @ 3.50 each", "host 10[.]2[.]333[.]4 is", "lists 1, 2, 3, 4 of", "device 0a:1b:2c:3d:4e:5f up", "card 4111.1111.1111.1112 no", "order no. 504-555-2652 is"]
    assert [every for _, every in private.spans_of(wrong, chooser)] == [[]] * len(wrong)
    six = "login from 2001:db8:85a3:12:ab:8a2e:370:7334 now"
    assert private.written(private.spans_of([six], chooser)[0][1]) == "ip:11:44"


def test_likely_proposals_are_no_negatives():
    for text in ("a at b dot org", "h 10[.]0[.]0[.]1", "4111/1111/1111/1111", "tel 504 555 2652", "x (504) 555-2652", "1:2:3:4:5:6:7:8"):
        assert not [e for e in private.examples(text) if e[1] in {s[2] for s in private.proposals(text) if private.likely(text, s)}], text
    for text in ("me @ home. Then", "10[.]0[.]0[.]256", "4111/1111/1111/1112", "order 504-555-2652", "a0:b1:c2:d3:e4:f5"):
        assert [e[2] for e in private.examples(text)].count(0), text


def test_copies_do_not_crowd_out_training(spark, many_private):
    rows = [tuple(r) for r in many_private.collect()]
    hot = " ".join(f"w {k} @ {k}.{k} or {k}/{k}/{k}/{'9' * (k % 7 + 2)}" for k in range(100, 140))
    docs = spark.createDataFrame(rows + [(1000 + i, hot) for i in range(200)], "doc_id long, text string").repartition(4)
    found = private.trained(docs, rows=2000)
    assert all(found.limits[k] <= 1 for k in (0, 1, 3)), found.limits


def test_training_draws_distinct_texts(spark, many_private):
    texts = many_private.select("text").union(many_private.limit(1).select("text").crossJoin(spark.range(2000)).select("text"))
    drawn = private.training_rows(texts.repartition(4), 10**6, 10**6)
    assert len({(r.digest, r.number) for r in drawn}) == len(drawn)
    assert sorted(drawn) == sorted(private.training_rows(many_private, 10**6, 10**6))
    assert len({r.digest for r in private.training_rows(texts, 100, 10**6)}) < 200


def test_disguised_spans_in_the_given_texts(spark, sf):
    """Limits exist on the smallest table; spans put into its texts are found, and nothing is found in them as they are."""
    table = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL")
    chooser, rnd = private.trained(table), random.Random(8)
    assert max(chooser.limits) <= 1, chooser.limits
    texts = [r.text for r in table.select("text").distinct().collect()]
    assert not [s for t, (base, every) in zip(texts, private.spans_of(texts, chooser), strict=True) for s in every if s not in base]
    made, wanted = [], []
    for i in range(800):
        words, own = rnd.choice(texts).split(" "), disguised(i % 4, rnd)
        at = rnd.randrange(len(words) + 1)
        before = " ".join([*words[:at], ""])
        made.append(before + " ".join([own, *words[at:]]))
        wanted.append((len(before), len(before) + len(own), i % 4))
    found = private.spans_of(made, chooser)
    share = [np.mean([w in every for w, (_, every) in zip(wanted, found, strict=True) if w[2] == k]) for k in range(4)]
    extra = sum(s not in base and s != w for w, (base, every) in zip(wanted, found, strict=True) for s in every)
    print("recall", [round(float(x), 3) for x in share], "others", extra)
    assert min(share) > 0.9 and extra < 16, (share, extra)


def test_shortened_addresses(spark, many_private):
    chooser = private.trained(many_private)
    texts = ["host 2001:db8::8a2e:370:7334 is up", "call std::abs and a::b here", "at 12::30 or bad::face"]
    assert [private.written(every) for _, every in private.spans_of(texts, chooser)] == ["ip:5:28", "", ""]


def test_private_in_odd_rows(docs, no_docs):
    got = private.found(docs).collect()
    assert len(got) == len(ROWS) and private.found(no_docs).count() == 0
    row = next(r for r in got if r.doc_id == 10)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    masked = private.redacted(docs)
    assert masked.columns == docs.columns
    texts = [r.text for r in masked.collect()]
    assert "write [EMAIL] or [PHONE] from [IP] with [CARD]" in texts and None in texts


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(oracle.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(str(tuple(r)) for r in got.select(columns).collect())
    assert rows == sorted(str(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({oracle.SQL[name]})").fetchall())


def test_all_are_registered():
    names = contract.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_pipeline(spark, docs):
    rows, kept = docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit("x").alias("node")), {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, rows, "").write.parquet(path)
        rows = spark.read.parquet(path)
        kept[name] = rows.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept[name])
    named, unique, cut, clean, packed = kept.values()
    assert sorted(str(r[1]) for r in named) == sorted(str(r[1]) for r in ROWS if re.search(r"[^\W\d_]", r[1] or ""))
    assert len(unique) == len({r.text for r in named}) - 1 and len(cut) == len(unique) == len(clean)
    assert not any("@" in r.text for r in clean)
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean}


def test_pipeline_rejects_what_is_no_language(spark, sf):
    rnd = random.Random(3)
    noise = [base64.b64encode(rnd.randbytes(n)).decode() for n in (200, 900, 5000)]
    noise += ["".join(rnd.choice("bcdfghjklmnpqrstvwxz  ") for _ in range(n)) for n in (300, 3000)]
    rows = [(10**9 + i, text, None, "s", len(text)) for i, text in enumerate([*noise, "1 + 2 = 3"])]
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = corpus_pipeline.identify(spark, table.union(spark.createDataFrame(rows, table.schema)), "").collect()
    assert not [r for r in got if r.doc_id >= 10**9]
    assert len(got) == table.where(F.col("text").rlike(r"\p{L}")).count()


def test_limits_are_drawn_towards_coarser_ones(spark, sf):
    """More copies of the same labelled rows move no limit by a step, and each lies below the scores it comes from."""
    table, before = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), None
    for times in (1, 2, 3):
        limits = languages.score_limits(table.crossJoin(spark.range(times)).selectExpr("doc_id * 3 + id AS doc_id", "text", "lang"))
        assert 0.1 < limits[None, None] < 0.8 and {k for k, _ in limits} > {None, "en"}
        if before:
            assert set(before) == set(limits) and all(0 <= limits[k] - before[k] < 0.15 for k in limits)
        before = limits
    assert languages.score_limits(table.limit(0)) == {(None, None): 0.0}


def test_und_as_a_label_is_kept(spark):
    words = {"und": "kala vesi talo puu", "en": "house river water tree"}
    rows = [(i, " ".join(rnd.choices(words[lang].split(), k=30)), lang, "s") for lang in words for rnd in [random.Random(1)] for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = corpus_pipeline.identify(spark, table, "").groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"und": 100, "en": 100}


def test_pipeline_of_no_documents(spark, no_docs):
    rows = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        rows = spark.createDataFrame([], stage(spark, rows, "").schema)
        assert rows.count() == 0

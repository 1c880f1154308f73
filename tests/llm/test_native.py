import random
import re
from collections import Counter

from pyspark.sql import functions as F

from loam.llm import quality_rules as Q, queries, urlfilter as U


def test_url_parts_and_canonical_form(spark):
    cases = {
        "HTTP://WWW.Ex.org:80/A/?b=2&utm_x=1&a=1#f": ("www.ex.org:80", "/A/", "ex.org/A?a=1&b=2"),
        "https://h?q": ("h", "", "h?q"), "no scheme": ("", "", None), "x://": ("", "", None), "a://É.org/p": ("É.org", "/p", "É.org/p"),
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string").select("url", U.url_host(F.col("url")).alias("h"), U.url_path(F.col("url")).alias("p"), U.canonical_url(F.col("url")).alias("c")).collect()
    assert {r.url: (r.h, r.p, r.c) for r in rows} == cases


def test_filter_is_exact_whatever_its_size(spark):
    urls = spark.range(2000).select(F.concat(F.lit("h"), (F.col("id") % 700).cast("string")).alias("canonical"), "id")
    listed = spark.range(0, 700, 7).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("canonical"))
    for bits in (1, 14):
        rows = U.in_list(urls, listed.union(listed), bits).collect()
        assert len(rows) == 2000 and all(r.listed == (r.id % 700 % 7 == 0) for r in rows)
    nulls = spark.createDataFrame([(1, None), (2, "h0")], "id int, canonical string")
    assert {r.id: r.listed for r in U.in_list(nulls, listed).collect()} == {1: False, 2: True}
    assert not U.in_list(urls, listed.limit(0)).filter("listed").count()


def test_rules_and_edges(spark):
    urls = ["http://a.com/x", "http://a.example.com/en/x", "http://www.example.com/en/x", "http://z.net/es/1", "http://z.net/de/1", "http://com", None, "junk", "http://com/"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge_urls(pages, U.listed_pages(pages), U.RULES).collect()}
    assert got == {0: ("com/", "allow"), 1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("com/", "allow")}
    assert U.judge_urls(pages.limit(0), U.listed_pages(pages), U.RULES).count() == 0


def plain_signals(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows, cover = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if windows[tuple(w[k : k + 3])] > 1:
            cover |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_signals_equal_brute_force(spark, sf_dir):
    extra = [None, "", " ", "a", "a a a", "a a a a", "a b c a b c", "x\n\nx\n y\n y", "a\xa0b é|é", "w " * 30_000, "1 2 3 " * 5 + "q"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string"))
    got = {r.doc_id: r for r in Q.judge_quality(docs).collect()}
    for d in docs.collect():
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_signals(d.text), (d.doc_id, d.text)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (r.kept and failed)


def test_junk_goes_and_labelled_good_stays(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    rows = {r.doc_id: r for r in queries.op10_quality_rules(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    bad = [rows[x.doc_id].kept for x in labels if x.quality == 0]
    good = [rows[x.doc_id].kept for x in labels if x.quality == 1 and not rows[x.doc_id].base_failed]
    assert sum(bad) / len(bad) < 0.05 and sum(good) / len(good) > 0.995


def test_estimates():
    patterns = [((-1, 0, 0), 30), ((0, 0, 1), 900), ((-1, -1, 0), 10), ((0, 0, 0), 5)]
    p = Q.fit_rules(patterns)
    assert p[0, 0, 1] > 0.7 and p[-1, 0, 0] < 0.3 and p[-1, -1, 0] < 0.1 and abs(p[0, 0, 0] - 0.5) < 1e-9
    assert p == Q.fit_rules(patterns[::-1]) and Q.fit_rules([]) == {}


def plain_posteriors(rows, rounds=100, prior=0.5, start=0.8, trust=0.25):
    """Expectation-maximisation row by row: a rule's chance of being right is the share of its votes that agree with the posterior, with `trust` times its votes, and one more, that agree as often as at the start."""
    right = [start] * len(rows[0])
    for _ in range(rounds):
        good = []
        for votes in rows:
            yes, no = prior, 1 - prior
            for v, p in zip(votes, right):
                yes, no = yes * (p if v == 1 else 1 - p if v == -1 else 1), no * (p if v == -1 else 1 - p if v == 1 else 1)
            good.append(yes / (yes + no))
        for r in range(len(right)):
            agreed = [g if votes[r] == 1 else 1 - g for votes, g in zip(rows, good) if votes[r]]
            extra = trust * len(agreed) + 1
            right[r] = min(0.999, max(0.5, (sum(agreed) + extra * start) / (len(agreed) + extra)))
    return good


def test_estimates_equal_plain_expectation_maximisation():
    rnd = random.Random(8)
    for _ in range(5):
        truth = [rnd.random() < 0.7 for _ in range(400)]
        skill = [rnd.uniform(0.55, 0.95) for _ in range(5)]
        rows = [tuple(0 if rnd.random() < 0.4 else (1 if t == (rnd.random() < s) else -1) for s in skill) for t in truth]
        got = Q.fit_rules(list(Counter(rows).items()))
        assert all(abs(got[v] - p) < 1e-6 for v, p in zip(rows, plain_posteriors(rows)))


def test_keep_good_and_empty(spark):
    docs = spark.createDataFrame([(1, "plain words here. " * 30, 3), (1, "*** $$$ " * 60, 4), (None, "plain text again. " * 30, 5)], "doc_id bigint, text string, good_id int")
    kept = Q.keep_good(docs).collect()
    assert {r.good_id for r in kept} <= {3, 5} and Q.keep_good(docs.limit(0)).count() == 0

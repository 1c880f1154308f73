import random
import re

from loam.llm import license_scan as L, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row2 = [0]
        for j, y in enumerate(b):
            row2.append(row[j] + 1 if x == y else max(row[j + 1], row2[j]))
        row = row2
    return row[-1]


def plain_base(w):
    at = sorted((i, label) for label, p in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def plain_labels(w, templates, share=L.SHARE):
    """Labels and the best share, by holding every window of every text against every template."""
    found, best = set(), 0.0
    for label, text in templates:
        t = words(text)
        wrong, width = L.tolerance(len(t), share)
        n = max((common(w[i : i + width], t) for i in range(max(1, len(w) - width + 1))), default=0)
        if n >= len(t) - wrong:
            found.add(label)
            best = max(best, n / len(t))
    return ",".join(sorted(found)), best


def test_base_equals_plain_search(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    rows = {r.doc_id: r for r in queries.op12_license_scan(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, w = rows[d.doc_id], words(d.text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), *plain_base(w)), d.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score > 0) == bool(r.labels)
        told = {"gpl-3": "GNU General Public License, version 3", "all-rights-reserved": "All rights reserved."}
        for label, notice in told.items():
            assert notice not in d.text or label in r.labels.split(",")


def mutated(rnd, text):
    w = text.split()
    for _ in range(rnd.randrange(0, 1 + len(w) // 6)):
        i = rnd.randrange(len(w))
        w[i : i + rnd.randrange(2)] = rnd.choice([[], ["xx"], ["license"], ["the", "yy"]])
    return " ".join(w)


def test_labels_equal_every_window_compared(spark):
    rnd, templates = random.Random(11), L.PHRASES + L.NOTICES
    filler = "the of license under version software public rights to reserved all by word".split()
    docs = [(i, " ".join([*rnd.choices(filler, k=rnd.randrange(30)), mutated(rnd, rnd.choice(templates)[1]), *rnd.choices(filler, k=rnd.randrange(30))])) for i in range(150)]
    docs += [(200 + i, " ".join([text, "between", text])) for i, (_, text) in enumerate(templates)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r for r in L.scan_licenses(frame).collect()}
    short = {r.doc_id for r in L.license_spans(frame, block=7).filter("template_id >= 0").select("doc_id").distinct().collect()}
    for i, t in docs:
        labels, best = plain_labels(words(t), templates)
        assert (got[i].labels, round(got[i].score, 9)) == (labels, round(best, 9)), t
        assert (i in short) == bool(labels)


def test_spans_and_edges(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    docs = [(1, f"x y {notice}"), (1, f"x y {notice}"), (None, "All rights  reserved"), (None, None), (3, ""), (4, "mit"), (5, "cc by nc " * 30_000), (6, f"{'w ' * 5000}{notice}"), (1, "other")]
    frame = spark.createDataFrame([(*d, 2) for d in docs], "doc_id bigint, text string, labels int")
    rows = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in L.scan_licenses(frame).collect()), key=str)
    want = [
        (1, 10, 1, 5, 5, "apache-2", "apache-2", 1.0), (1, 10, 1, 5, 5, "apache-2", "apache-2", 1.0), (1, 1, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), (4, 1, 0, None, None, "", "", 0.0),
        (5, 90_000, 30_000, 0, 89_997, "cc-by-nc", "cc-by-nc", 1.0), (6, 5008, 1, 5003, 5003, "apache-2", "apache-2", 1.0), (None, 0, 0, None, None, "", "", 0.0), (None, 3, 0, None, None, "", "all-rights-reserved", 1.0),
    ]
    assert rows == sorted(want, key=str)
    spans = [(r.first_word, r.last_word, r.share, r.exact) for r in L.license_spans(frame.filter("doc_id = 6")).filter("label = 'apache-2'").orderBy("first_word").collect()]
    assert (5000, 5007, 1.0, True) in spans
    assert L.scan_licenses(frame.limit(0)).count() == 0 and L.scan_licenses(frame, [], []).filter("labels <> ''").count() == 0

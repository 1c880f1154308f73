import hashlib
import math
import random
import re
import zlib
from collections import Counter

from loam.llm import queries, resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, grams):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, grams + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=10, least=20, grams=1, buckets=10_000, seed=2024):
    """(doc_id, n_features, weight, score, rank) of all rows, sorted as a whole."""
    own = [(i, *features(t, grams)) for i, t in docs]
    s = Counter(f % buckets for _, _, fs in own for f in fs)
    t = Counter(f % buckets for x in target for f in features(x, grams)[1] for f in [f])
    big_s, big_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))

    rows = []
    for i, w, fs in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(f % buckets) for f in fs)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)])
    may = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): n for n, r in enumerate(may[: len(may) * percent // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def test_query_equals_a_plain_sort(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = [tuple(r) for r in queries.op11_resample(spark, sf_dir).collect()]
    assert sorted(got, key=str) == plain(docs, target)


def test_longer_features_small_tables_and_edges(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(["a", "B", "été", "x9", "z"], k=rnd.randrange(0, 40))) for _ in range(120)] + [None, "", "...", "w " * 40_000]
    docs = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 5
    frame, target = spark.createDataFrame([(*d, 9) for d in docs], "doc_id bigint, text string, weight int"), spark.createDataFrame([("a a b",), (None,)], "text string")
    for percent, least in ((10, 5), (100, 0), (1, 20), (0, 0)):
        scored = R.score_documents(frame, target, grams=3, buckets=50)
        got = sorted((tuple(r) for r in R.draw(scored, percent, least, pivots=3).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
        want = plain(docs, ["a a b", None], percent, least, 3, 50)
        assert [r[:4] for r in got] == [r[:4] for r in want]
        assert sorted((r[4], r[3], str(r[0])) for r in got if r[4]) == sorted((r[4], r[3], str(r[0])) for r in want if r[4])
    assert R.draw(R.score_documents(frame.limit(0), target)).count() == 0
    assert R.draw(R.score_documents(frame, target.limit(0))).count() == len(docs)


def test_selection_finds_every_rank(spark):
    rows = [(rnd, i % 5 == 0, None if i % 5 == 0 else f"it's \\{i % 3}", 7, i) for i, rnd in enumerate(random.Random(1).choices(range(6), k=60))]
    frame = spark.createDataFrame(rows, "lower bigint, no_id boolean, doc_id string, digest bigint, row bigint")
    order = sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3], r[4]))
    for k in (1, 2, 17, 31, 59, 60):
        assert tuple(R.kth_key(frame, k, pivots=2)) == order[k - 1]


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, "tell me more " * 10, "x", i) for i in range(30)], "doc_id bigint, text string, lang string, rank int")
    rows = R.resample(docs, spark.createDataFrame([("tell",)], "text string"), 20).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5, 6] and rows[0].asDict().keys() == {"doc_id", "text", "lang", "rank"}

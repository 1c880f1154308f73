import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from loam.llm import quality_net, queries


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    rows = {r.doc_id: r for r in queries.op7_quality(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(x.quality, rows[x.doc_id]) for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[x.doc_id].held_out]
    y, s = np.array([q for q, _ in held]), np.array([r.score for _, r in held])
    assert auc(y, s) > 0.95
    assert (np.array([r.predicted for _, r in held]) == y).mean() > 0.93
    for lo, hi in ((0, 0.2), (0.8, 1.01)):  # calibration
        inside = (s >= lo) & (s < hi)
        assert abs(y[inside].mean() - s[inside].mean()) < 0.1


def plain_vectors(texts, least):
    """Every word's own vector and the pooled documents, straight from the definition."""
    said = []
    for text in texts:
        said.append([f"^{w.lower()}" if len(w) > 1 and w.isupper() else w.lower() for w in re.findall(r"[^\W_]+|[^\w\s]+|_+", text or "")])
    counts = Counter(w for words in said for w in words)

    def index(word):
        code = (xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63) >> 7) & 0xFFFFFF
        out = np.zeros(quality_net.DIM)
        for i in range(4):
            out[code >> 5 * i & 31] += -1 if code >> (20 + i) & 1 else 1
        return out

    sums = {w: np.zeros(quality_net.DIM) for w in counts}
    for words in said:
        for a, b in zip(words, words[1:]):
            sums[a] += index(b)
            sums[b] += index(a)
    unit = {w: (v / np.linalg.norm(v) if v.any() else v).astype(np.float16).astype(float) for w, v in sums.items() if counts[w] >= least}
    rows = []
    for words in said:
        known = [unit[w] for w in words if w in unit]
        mean = np.sum(known, axis=0) / len(known) if known else np.zeros(quality_net.DIM)
        rows.append(np.array([*mean, np.linalg.norm(mean), 1 - len(known) / max(1, len(words)), np.log1p(len(words))]))
    return rows


@pytest.mark.parametrize(("most_sent", "dense"), [(1_000_000, 32_768), (1_000_000, 10), (40, 8), (0, 0)])
def test_vectors_equal_the_definition_whichever_way_they_come(spark, monkeypatch, most_sent, dense):
    monkeypatch.setattr(quality_net, "DENSE", dense)
    monkeypatch.setattr(quality_net, "HELD", 500)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(150)] + ["É", "ABC", "abc", "$$", "_"]
    weights = [1 / (i + 1) for i in range(155)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 60))) for _ in range(200)] + [None, "", "x" * 5000, "once"]
    ids = [*range(200), 300, 301, 302, None]
    rows = [*zip(ids, texts), (7, texts[7]), (7, "w1 w2 other text")]
    got = quality_net.pooled(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, most_sent).collect()
    want = plain_vectors([t for _, t in rows], 3)
    key = lambda x: (str(x[0]), [round(float(v), 3) for v in x[1]])
    for (i, v), (j, w) in zip(sorted(((r.doc_id, r.vector) for r in got), key=key), sorted(zip([i for i, _ in rows], want), key=key), strict=True):
        assert i == j and np.allclose(v, w, atol=2e-4), i


def test_gradients_are_those_of_the_loss():
    """One step of Adam moves every weight against the numeric gradient."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(50, 6)), (rng.random(50) < 0.5).astype(float)
    before, after = (quality_net.Network(hidden=5).fit(x, y, epochs=n, batch=1000, rate=1e-4, decay=0.0) for n in (0, 1))
    rows = np.random.default_rng(7).permutation(50)[10:]

    def loss(net):
        p = 1 / (1 + np.exp(-net.logits(x[rows])))
        return -(y[rows] * np.log(p) + (1 - y[rows]) * np.log(1 - p)).mean()

    for name in ("w1", "b1", "w2", "b2"):
        own = getattr(before, name)
        for at in np.ndindex(np.shape(own)):
            up, down = np.array(own, float), np.array(own, float)
            up[at] += 1e-5
            down[at] -= 1e-5
            setattr(before, name, up)
            high = loss(before)
            setattr(before, name, down)
            slope = (high - loss(before)) / 2e-5
            setattr(before, name, own)
            if abs(slope) > 1e-5:
                assert np.sign(getattr(after, name)[at] - np.asarray(own)[at]) == -np.sign(slope), (name, at)


def test_edges(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["good", "fine", "text", "here"]) for _ in range(40)) if i % 2 else " ".join(rng.choice(["$$$", "***", "buy", "now"]) for _ in range(40)), "s") for i in range(200)]
    rows += [(500, None, "s"), (501, "", "s"), (502, "ab " * 300_000, "s"), (3, rows[3][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, None), (7, 1)], "doc_id bigint, quality int")
    got = quality_net.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert sum((r.doc_id % 2 == 1) == (r.score > 0.5) for r in got if r.doc_id < 200) >= 195
    assert quality_net.score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_net.score_quality(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality_net.score_quality(docs, labels.limit(0)).collect()} == {0.5}

import os
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest

from loam.llm import minhash


def counted(text):
    w = minhash.words_of((text or "").encode())
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(docs, threshold=0.8):
    """doc_id -> least doc_id of its class, from all pairs that share a shingle."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    texts = defaultdict(list)
    for i, t in docs:
        texts[t].append(i)
    counts = {min(ids): counted(t) for t, ids in texts.items()}
    shared = defaultdict(set)
    for i, c in counts.items():
        for s in c:
            shared[s].add(i)
    pairs = {p for ids in shared.values() for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        if similarity(counts[a], counts[b]) >= threshold:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(min(ids)) for ids in texts.values() for i in ids}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for overlap in (20, 60, 90):
        a = {i: int(rng.integers(1, 4)) for i in range(100)}
        b = {i + 100 - overlap: (a.get(i + 100 - overlap) or 2) for i in range(100)}
        keys = [mix for mix in (a, b)]
        doc = np.repeat([0, 1], [len(a), len(b)])
        hashes = minhash.mixed(np.array([*keys[0], *keys[1]], np.uint64) + np.uint64(77))
        signatures = minhash.dart_signatures(doc, hashes, np.array([*a.values(), *b.values()]), 2, 2000)
        want = sum(min(a.get(i, 0), b.get(i, 0)) for i in {*a, *b}) / sum(max(a.get(i, 0), b.get(i, 0)) for i in {*a, *b})
        assert abs((signatures[0] == signatures[1]).mean() - want) < 0.05


def test_short_and_heavy_documents_fill_every_coordinate():
    doc = np.array([0, 1, 1])
    signatures = minhash.dart_signatures(doc, minhash.mixed(np.array([1, 2, 3], np.uint64)), np.array([1, 5000, 1]), 3, 80)
    assert (signatures[:2] != 0).all() and (signatures[2] == 0).all()


def test_classes_equal_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_chain_of_edits_and_many_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows, chain = [], list(words)
    for i in range(30):
        rows.append((i, " ".join(chain)))
        chain[(i * 37) % 200] = f"new{i}"
    rows += [(100 + i, "an exact copy of some eight words here") for i in range(400)]
    rows += [(1000, None), (1001, None), (1002, ""), (1003, "two words"), (1004, "two words!"), (1005, " ".join(reversed(words)))]
    rows += [(50, rows[0][1]), (50, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    want = brute_classes([r for r in rows])
    assert got == want and len(set(got.values())) == 6
    kept = sorted(r.doc_id for r in minhash.one_of_each(docs).collect())
    assert kept == sorted(set(want.values()))


def test_rows_without_ids_are_all_judged(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text + " one more"
    rows = [(None, "some words that no other text has at all"), (None, "quite different words of another text here"), (7, text), (None, near), (None, text), (None, None), (3, "seven small words stand here like that")]
    rows += [(None, " ".join(f"v{i}" for i in range(60))), (None, " ".join(f"v{i}" for i in range(61)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and sum(r.class_id == 7 for r in got) == 3
    kept = minhash.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [3, 7] and len(kept) == 6
    assert {r.text for r in kept if r.doc_id is None} >= {rows[0][1], rows[1][1], None}


@pytest.mark.skipif(not os.environ.get("SLOW_TESTS"), reason="takes minutes; set SLOW_TESTS=1")
def test_nothing_is_lost_at_a_tenth(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_every_link_of_a_sample_is_kept_at_a_tenth(spark, sf_dir):
    """A fiftieth of the documents against all of the larger table: recall of links is 1, and classes hold linked texts only."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    counts = {r.doc_id: counted(r.text) for r in docs.select("doc_id", "text").collect()}
    sample = [i for i in sorted(counts) if i % 50 == 0]
    wanted, shared = {s for i in sample for s in counts[i]}, defaultdict(list)
    for i, c in counts.items():
        for s in wanted & c.keys():
            shared[s].append(i)
    links = 0
    for a in sample:
        both = Counter(i for s in counts[a] for i in shared[s])
        # Equal sizes at least to four fifths, and as many different shingles in common.
        for b in (i for i, n in both.items() if i != a and 0.8 * sum(counts[a].values()) <= sum(counts[i].values()) <= 1.25 * sum(counts[a].values())):
            if similarity(counts[a], counts[b]) >= 0.8:
                links += 1
                assert got[a] == got[b], (a, b)
        mates = [i for i in got if got[i] == got[a] and i != a]
        assert not mates or any(similarity(counts[i], counts[j]) >= 0.8 for i in [a] for j in mates)
    assert links > 20


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x")], "doc_id bigint, text string, node string")
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.one_of_each(docs).collect()[0].node == "x"


def test_pairs_in_a_bucket_of_many_classes_are_all_found(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(400):
        own = list(base)
        for j in range(6):
            own[(8 + 17 * j + int(rng.integers(0, 5))) % 100] = f"own{i}x{j}"
        rows.append((i, " ".join(own)))
    for i in range(0, 400, 40):  # a partner for some, like no other
        rows.append((1000 + i, rows[i][1] + f" tail{i} end{i}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute_classes(rows)
    assert len(set(want.values())) > 350
    # Bands of one coordinate: nearly all texts meet in crowded buckets. No turns: the exact pass alone finds the pairs.
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, bands=80, turns=0).collect()}
    assert got == want

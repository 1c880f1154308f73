import itertools
import random

from loam.llm import filter_audit as A, queries


def plain(docs, labels):
    """STEPS of (doc_id, text, lang) rows by applying every order to every row."""
    first, rows = {}, []
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang in docs:
        t = t or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i,
        }
        own = [x for x in labels if x[0] == i and i is not None]
        rows.append((lang or "", {f for f, bad in fails.items() if bad}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {r[0] for r in rows}:
        here, shapley, found = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = set(order[: step - 1])
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), sum(f in r[1] and bool(r[1] & before) for r in here), sum(r[1] == {f} for r in here), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in found]
    return sorted(out)


def test_query_equals_every_order_applied(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_filter_audit(spark, sf_dir).collect()) == plain(docs, labels)


def test_edges(spark):
    docs = [
        (1, "Aa #", "en"), (2, "Aa #", "de"), (2, "Aa #", "de"), (2, "Aa #", None), (None, "Aa #", "en"), (None, None, ""), (5, "", None), (4, None, "en"), (6, "w " * 300_000, "en"),
        (7, " ".join(map(str, range(250))), "en"), (1, "other", "fr"), (8, "é\x0bb\x85c d | E", "en"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (None, 1, 1), (6, 1, None), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, 3) for d in docs], "doc_id bigint, text string, lang string, mask int")
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert sorted(tuple(r) for r in A.audit(frame, told).collect()) == plain(docs, labels)
    assert A.audit(frame.limit(0), told).count() == 0
    assert sorted(tuple(r) for r in A.audit(frame, told.limit(0)).collect()) == plain(docs, [])


def test_swaps_visit_every_order_and_keep_the_counts():
    rnd = random.Random(3)
    for _ in range(20):
        counts = {m: (rnd.randrange(4), rnd.randrange(3), rnd.randrange(2)) for m in rnd.sample(range(32), rnd.randrange(1, 32))}
        d, seen = A.Diagram("ABCDE", counts, 3), set()
        for level in [None, *A.neighbour_swaps(5)]:
            if level is not None:
                d.swap(level)
            seen.add("".join(d.order))
            again = A.Diagram("".join(d.order), counts, 3)
            assert d.all_pass() == again.all_pass() and list(map(len, d.pairs)) == list(map(len, again.pairs))
        assert len(seen) == 120


def test_equal_subdiagrams_are_one_node():
    d = A.Diagram("ABCDE", {m: (1, 0, 0) for m in range(32)}, 3)
    assert [len(x) for x in d.pairs] == [1, 1, 1, 1, 1] and d.weights()[0][d.root] == (32, 0, 0)

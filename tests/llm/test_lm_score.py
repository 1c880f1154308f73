import math
import zlib
from collections import Counter

import numpy as np
import pytest

from loam.llm import ctw, lm_score, queries


def plain_weighted(counts, depth, context, symbol):
    """Bits of a symbol by the definition, with dictionaries and exact recursion."""
    stats = {}
    for (ctx, s), n in counts.items():
        for d in range(depth + 1):
            for k in range(8):
                node = (256 | s) >> (8 - k)
                cell = stats.setdefault((ctx[len(ctx) - d :], node), [0, 0])
                cell[(s >> (7 - k)) & 1] += n

    def block(cell):
        a, b = cell
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def weighted(ctx, node):
        own = block(stats[ctx, node])
        if len(ctx) == depth:
            return own
        below = sum(weighted(c, m) for c, m in stats if m == node and len(c) == len(ctx) + 1 and c[1:] == ctx)
        return math.log(0.5) + np.logaddexp(own, below)

    bits = 0.0
    for k in range(8):
        node, bit = (256 | symbol) >> (8 - k), (symbol >> (7 - k)) & 1
        seen = [d for d in range(depth + 1) if (context[len(context) - d :], node) in stats]
        chance = 0.5
        for d in reversed(seen):
            ctx = context[len(context) - d :]
            cell = stats[ctx, node]
            kt = (cell[bit] + 0.5) / (sum(cell) + 1)
            share = 1.0 if d == seen[-1] else math.exp(math.log(0.5) + block(cell) - weighted(ctx, node))
            chance = share * kt + (1 - share) * chance
        bits -= math.log2(chance)
    return bits


def test_costs_equal_the_definition():
    texts, depth = [b"abracadabra", b"abacus", b"", b"cab"], 2
    counts = Counter()
    for t in texts:
        full = b"\xff\xff" + t + b"\xff"
        for i in range(depth, len(full)):
            counts[full[i - depth : i], full[i]] += 1
    grams, n = ctw.spread(texts, depth)
    assert n.tolist() == [12, 7, 1, 4] and len(grams) == 24
    keys, weights = ctw.tally(grams, np.ones(len(grams)))
    whole, _ = ctw.grow(keys, weights, depth, 0)
    for t in (b"abra", b"zebra", b"", b"ca\xc3\xa9"):
        full = b"\xff\xff" + t + b"\xff"
        want = sum(plain_weighted(counts, depth, full[i - depth : i], full[i]) for i in range(depth, len(full)))
        own, _ = ctw.spread([t], depth)
        assert abs(ctw.cost(whole, own).sum() - want) < 1e-9
        assert abs(ctw.GramCosts(*np.unique(own, return_index=True)[:1], ctw.cost(whole, np.unique(own)), depth).text_bits([t])[0] - want) < 1e-4


@pytest.mark.parametrize("depth", [1, 2, 4, 5])
def test_joined_levels_equal_one_tree(spark, depth):
    """Costs from levels that Spark puts together equal those of one tree, for grams seen and not seen, in whatever groups they grow."""
    texts = [b"the cat sat on the mat", b"the hat of the cat", b"abracadabra", b"a rat ate the oat"]
    other = [b"the rat sat", b"zebra \xc3\xa9 cat", b"catamaran of the abbot"]
    train, _ = ctw.spread(texts, depth)
    both, _ = ctw.spread(texts + other, depth)
    keys, n = ctw.tally(both, np.concatenate([np.ones(len(train)), np.zeros(len(both) - len(train))]))
    whole, _ = ctw.grow(keys[n > 0], n[n > 0], depth, 0)
    want = dict(zip(keys.view(np.int64).tolist(), ctw.cost(whole, keys).tolist()))
    counts = spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys.view(np.int64), n)], "gram bigint, n bigint")
    for grams_each in (1_000_000, 7):
        got = {r.gram: r.bits for r in lm_score.gram_costs(counts, depth, grams_each).collect()}
        assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-5 for g in want)


def test_probabilities_add_up_to_one():
    grams, _ = ctw.spread([b"the cat sat on the mat"] * 3, 3)
    levels, _ = ctw.grow(*ctw.tally(grams, np.ones(len(grams))), 3, 0)
    for context in (b"the", b"cat", b"zzz"):
        base = int.from_bytes(context, "big") << 8
        assert abs((2.0 ** -ctw.cost(levels, np.arange(base, base + 256, dtype=np.uint64))).sum() - 1) < 1e-9


def by_hand(docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in docs}
    counts = Counter(w for i, ws in words.items() if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in words.items()}


def test_whole_table(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    rows = queries.op1_lm_score(spark, sf).collect()
    want = by_hand([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert len(rows) == len(want)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert abs(r.base_score - want[r.doc_id][4]) < 1e-6 * abs(want[r.doc_id][4]) and r.score < 0


def test_held_out_texts_cost_less_than_with_word_counts(spark, sf_dir):
    held = [r for r in queries.op1_lm_score(spark, sf_dir.replace("0.001", "0.1")).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "Word word WORD", 3), (3, "Word word WORD", 3), (9, "x " * 50_000, 4), (None, "no id", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = lm_score.score_documents(docs).collect()
    assert len(got) == 6 and all(r.score < 0 and r.n_tokens >= 1 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1} and len({r.score for r in got if r.doc_id == 3}) == 1
    assert lm_score.score_documents(docs.limit(0)).count() == 0
    plain = lambda rows: sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in rows)
    # A block for each row, and grams and words by broadcast, by shuffle or both ways: nothing changes.
    for options in ({"block_bytes": 10, "most_grams": 0, "most_words": 0}, {"most_grams": 40, "most_words": 2}, {"block_bytes": 10}):
        assert plain(lm_score.score_documents(docs, **options).collect()) == plain(got)

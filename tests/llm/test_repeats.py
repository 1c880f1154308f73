import random

from loam.llm import repeats


def words(rng, n):
    return " ".join("".join(rng.choice(["on", "er", "th", "an", "é", "re", "ti", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_chunks_cover_the_text_and_resist_insertions():
    rng = random.Random(1)
    text = words(rng, 2000).encode()
    moved = b"something put in front " + text
    (a,), (b,) = repeats.chunk_ends([text]), repeats.chunk_ends([moved])
    assert a[-1] == len(text) and a == sorted(set(a))
    shift = len(moved) - len(text)
    assert len({x + shift for x in a} - set(b)) <= 6
    assert all(y - x <= repeats.MOST for x, y in zip([0, *a], a))
    assert all((text + b" ")[x] & 0xC0 != 0x80 for x in a)
    assert repeats.chunk_ends([text, moved]) == [a, b] and repeats.chunk_ends([b"", b"x"]) == [[], [1]]
    assert repeats.chunk_ends(["é".encode() * 5000])[0][-1] == 10000


def test_planted_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(2)
    rows, planted = [], set()
    for p in range(100):
        passage = words(rng, 55)
        for j in range(3):
            rows.append((10 * p + j, f"{words(rng, rng.randint(5, 80))} {passage} {words(rng, rng.randint(5, 80))}"))
            planted.add(10 * p + j)
    clean = [(5000 + i, words(rng, 100) + "\nLicensed under the Apache License, Version 2.0.") for i in range(200)]
    rows += [*clean, (9000, None), (9001, ""), (9002, "short"), (9003, "again " * 500), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = repeats.repeated_passages(docs).collect()
    got = {r.doc_id for r in found}
    texts = dict(rows)
    same = sum(texts[r.doc_id][r.start : r.end] in texts[r.first_doc_id] for r in found)
    assert same >= 0.99 * len(found)
    assert len(planted & got) >= 0.98 * len(planted) and not got & {i for i, _ in clean} and not {9000, 9001, 9002, 9003} & got
    for r in found:
        assert 13 <= r.n_words <= 57
        assert r.kept == (r.doc_id == r.first_doc_id)
    kept = {r.doc_id: r.text for r in repeats.remove_repeats(docs).collect()}
    assert all(kept[i] == t for i, t in rows if i % 10 == 0 and i < 1000) and sum(len(kept[i]) < len(texts[i]) for i in planted) >= 196
    assert kept[9000] is None and kept[5000] == texts[5000]


def test_whole_copies_and_empty_table(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{j}" for j in range(100)), 1) for i in range(300)], "doc_id bigint, text string, tag int")
    rows = repeats.repeated_passages(docs).collect()
    assert len(rows) == 300 and {(r.start, r.n_words, r.first_doc_id) for r in rows} == {(0, 100, 0)} and sum(r.kept for r in rows) == 1
    assert repeats.repeated_passages(docs.limit(0)).count() == 0


def test_rows_without_ids_lose_their_repeats_too(spark):
    passage = words(random.Random(3), 60)
    rows = [(1, "first " + passage + " one"), (None, "second " + passage + " two"), (None, "quite another text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = repeats.repeated_passages(docs).collect()
    assert sorted((r.doc_id is None, r.first_doc_id, r.kept) for r in found) == [(False, 1, True), (True, 1, False)]
    left = {len(r.text) < len(passage) / 2 for r in repeats.remove_repeats(docs).collect() if r.doc_id is None}
    assert left == {True} and repeats.remove_repeats(docs).count() == 3


def runs_of(text, n):
    """Every run of n words of a text."""
    w = (text or "").split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_whole_table_against_all_common_runs(spark, sf_dir):
    """Every document that has 51 words in a row in common with another is found, and none that has not even 12."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").collect()}

    def sharing(n):
        owners, out = {}, set()
        for i, text in docs.items():
            for run in runs_of(text, n):
                first = owners.setdefault(run, i)
                if first != i:
                    out |= {i, first}
        return out

    found = repeats.repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()
    got, long = {r.doc_id for r in found}, sharing(51)
    assert len(long & got) >= 0.96 * len(long) and len(long) > 50
    assert got <= sharing(12)
    # What is missed says one thing over and over, so that it has few chunk ends.
    assert all(len(set(docs[i].split())) < 0.1 * len(docs[i].split()) for i in long - got)


def test_rows_of_one_id_keep_their_own_places(spark):
    rng = random.Random(9)
    shared = [words(rng, 60) for _ in range(200)]
    rows = [(i, f"{words(rng, 20)} {p}") for i, p in enumerate(shared)] + [(1000, f"{words(rng, rng.randrange(5, 90))} {p} {words(rng, 20)}") for p in shared]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = [r.text for r in repeats.remove_repeats(docs).collect() if r.doc_id == 1000]
    middles = [" ".join(p.split()[20:40]) for p in shared]
    assert len(left) == 200 and sum(any(m in t for m in middles) for t in left) <= 4
    starts = {t.split()[0] for i, t in rows if i == 1000}
    assert {t.split()[0] for t in left} <= starts and min(len(t.split()) for t in left) >= 20

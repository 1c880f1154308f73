import hashlib
import re

from loam.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items, width=10):
    """(hit words, items) by comparing every window with every window."""
    w, hit, which = words(text), set(), set()
    for item, t in items.items():
        iw = words(t)
        n = min(width, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                which.add(str(item))
    return hit, which


def check(docs, items, rows):
    for (i, text), r in zip(sorted(docs, key=str), sorted(rows, key=lambda r: str((r.doc_id, r.text)))):
        hit, which = plain_hits(text, dict(items))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words(text)), len(hit), len(which), bool(hit)), (i, text)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(which)).encode()).hexdigest()


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short ITEM here"), (3, None), (4, "..."), (5, "short item here"), (10, "Été déjà vu")]
DOCS = [
    (1, "zero ONE two, three four five six seven eight nine ten then eleven"), (2, "one two three four five six seven eight nine"), (3, "a short-item here and short item here"), (4, None), (5, ""), (6, "été déjà vu"), (7, "Été déjà vu short"),
    (8, "x " * 30_000 + "two three four five six seven eight nine ten eleven twelve"), (3, "a short-item here and short item here"),
]


def test_small_cases_in_one_and_many_blocks(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    check(DOCS, ITEMS, D.find_contamination(docs, items).collect())
    check(DOCS, ITEMS, D.find_contamination(docs, items, max_windows=2).collect())


def test_removal_and_edges(spark):
    docs, items = spark.createDataFrame([(i, t, 7) for i, t in DOCS], "doc_id bigint, text string, n_hit int"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert sorted(r.doc_id for r in D.decontaminate(docs, items).collect()) == [2, 4, 5, 6]
    cleaned = {r.doc_id: r for r in D.decontaminate(docs, items, remove="spans").collect()}
    assert cleaned[1].text == "zero  then eleven" and cleaned[1].n_hit == 7 and cleaned[4].text is None and cleaned[3].text == "a  and "
    assert D.find_contamination(docs.limit(0), items).count() == 0
    assert not D.find_contamination(docs, items.limit(0)).filter("contaminated").count()


def test_columns_with_any_names_come_back(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", 5, "x", True, 7), (None, "nothing here", 6, "y", False, 8)], "doc_id bigint, text string, hit_at int, had_at string, clean boolean, n_hit int")
    bench = spark.createDataFrame([(9, "b c d e f g h i j k")], "item_id bigint, text string")
    for most in (1, 100):
        rows = D.find_contamination(docs, bench, max_windows=most).collect()
        assert sorted((r.hit_at, r.had_at, r.clean, r.n_hit, r.contaminated) for r in rows) == [(5, "x", True, 10, True), (6, "y", False, 0, False)]


def test_an_item_without_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in D.find_contamination(docs, spark.createDataFrame([(None, "a b"), (7, "b c")], "item_id bigint, text string")).collect()}
    assert rows[1].n_items == 2 and rows[1].items_sha256 == hashlib.sha256(b"7,None").hexdigest() and not rows[2].contaminated

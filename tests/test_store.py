import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from loam.operators import retrieval
from loam.operators.keyword_index import KeywordIndex
from loam.operators.upkeep import section_rows
from loam.sources.store import StoredTable, reingest
from loam.sources.tables import with_checkpoints

KIND = "id bigint, source string, content string, created_at timestamp"
NOW = dt.datetime(2024, 5, 1)


def content_of(table):
    return sorted(((r.id, r.source, r.content, r.created_at) for r in table.rows().collect()), key=str)


def files_of(path):
    return {(os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_changes_equal_a_plain_sequence_and_leave_other_files_alone(spark, tmp_path):
    path, rnd = str(tmp_path / "t"), random.Random(3)
    plain = {i: (i, f"source:s{i % 3}|u{i}", f"text {i}", NOW) for i in range(200)}
    table = StoredTable.created(spark.createDataFrame(list(plain.values()), KIND), path, buckets=16)
    assert content_of(table) == sorted(plain.values(), key=str) and table.version == 0
    for step in range(6):
        kept, before = files_of(path), dict(plain)
        ids = rnd.sample(range(260), 3)
        if step % 3 == 0:
            new = [(1000 + step * 10 + i, "mcp", f"new {i}", None) for i in range(3)]
            table = table.inserted(spark.createDataFrame(new, KIND), F.lit(NOW))
            plain |= {r[0]: (*r[:3], NOW) for r in new}
        elif step % 3 == 1:
            table = table.changed(spark.createDataFrame([(i, f"changed {step}") for i in ids], "id bigint, content string"))
            plain |= {i: (*plain[i][:2], f"changed {step}", plain[i][3]) for i in ids if i in plain}
        else:
            table = table.upserted(spark.createDataFrame([(i, "up", "serted", NOW) for i in ids], KIND)).deleted(spark.createDataFrame([(ids[0],), (-5,)], "id bigint"))
            plain |= {i: (i, "up", "serted", NOW) for i in ids}
            del plain[ids[0]]
        assert content_of(table) == sorted(plain.values(), key=str)
        assert kept <= files_of(path)  # nothing that was there is written again
        assert content_of(StoredTable(spark, path, 0))[:1] and len(before)
    held = {f for own in table.manifest["files"].values() for f in own}
    first = {f for own in StoredTable(spark, path, 0).manifest["files"].values() for f in own}
    assert held & first  # buckets that no change touched
    table = table.deleted_where(F.col("source").startswith("source:s1|"))
    plain = {i: r for i, r in plain.items() if not r[1].startswith("source:s1|")}
    assert content_of(table) == sorted(plain.values(), key=str)
    assert table.vacuumed(1) > 0 and content_of(StoredTable(spark, path)) == sorted(plain.values(), key=str)


def test_two_writers_of_one_version(spark, tmp_path):
    table = StoredTable.created(spark.createDataFrame([(1, "a", "b", NOW), (None, "n", "o", NOW)], KIND), str(tmp_path / "t"), buckets=4)
    again = StoredTable(spark, table.path)
    gone = spark.createDataFrame([(1,)], "id bigint")
    assert [r[0] for r in content_of(table.deleted(gone))] == [None]
    with pytest.raises(Exception, match="already exists"):
        again.deleted(gone)
    assert StoredTable(spark, table.path).version == 1
    empty = StoredTable.created(spark.createDataFrame([], KIND), str(tmp_path / "e"))
    assert content_of(empty) == [] and content_of(empty.upserted(spark.createDataFrame([(7, "x", "y", NOW)], KIND))) == [(7, "x", "y", NOW)]


def test_a_source_comes_again(spark, tmp_path):
    with_checkpoints(spark)
    kind, long = "id bigint, source string, content string", "a sentence that is long enough to be kept. "
    memories = StoredTable.created(spark.createDataFrame([(1, "source:w|u1", "old one"), (2, "source:w|u2", "old two"), (3, "mcp", "other")], kind), str(tmp_path / "m"), buckets=4)
    pages = StoredTable.created(spark.createDataFrame([("u1", "h"), ("u2", "h")], "url string, content_hash string"), str(tmp_path / "p"), "url", 4)
    first = spark.createDataFrame([("u1", f"## A\n\n{long}\n\n## B\n\n{long}"), ("u3", long), ("u4", "tiny")], "url string, content string")
    memories, pages = reingest(memories, pages, first, "source:w", 10, section_rows)
    rows = sorted(tuple(r) for r in memories.rows().collect())
    assert rows == [(2, "source:w|u2", "old two"), (3, "mcp", "other"), (10, "source:w|u1", f"## A\n\n## A\n\n{long.strip()}"), (11, "source:w|u1", f"## B\n\n## B\n\n{long.strip()}"), (12, "source:w|u3", long.strip())]
    assert {r.url for r in pages.rows().collect()} == {"u1", "u2", "u3"}
    held = memories.manifest["files"]
    memories, pages = reingest(memories, pages, first, "source:w", 20, section_rows)
    assert sorted(tuple(r) for r in memories.rows().collect()) == rows and memories.manifest["files"] == held


def listed(frame):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 7)) for r in frame.collect())


def test_keyword_index_equals_search_over_texts(spark, tmp_path):
    with_checkpoints(spark)
    rnd = random.Random(9)
    vocabulary, weights = [f"w{i}" for i in range(300)], [1 / (i + 1) for i in range(300)]
    texts = {i: " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(3, 60))) for i in range(3000)} | {3000: None, 3001: "", 3002: "W0, w1! w299"}
    items = spark.createDataFrame(list(texts.items()), "id bigint, content string")
    queries = spark.createDataFrame([(1, "w0 w7"), (2, "w250 w3"), (3, "W299 nothing"), (4, "unknown"), (5, "w5"), (6, "w1 w2 w40 w100 w200"), (7, "")], "query_id bigint, text string")
    index = KeywordIndex.built(items, str(tmp_path / "k"))
    assert listed(index.search(queries, 5)) == listed(retrieval.keyword_search(items, queries, 5))
    read, known = (f.count() for f in index.last_blocks)
    assert read < known  # blocks that can't win aren't read
    gone = spark.createDataFrame([(i,) for i in range(0, 3000, 4)] + [(99_999,)], "id bigint")
    fresh = spark.createDataFrame([(5000 + i, f"w7 w299 {'w0 ' * i}") for i in range(20)] + [(4, "w250 w250 again")], "id bigint, content string")
    index.delete(gone)
    index.add(fresh)
    now = items.join(gone, "id", "left_anti").union(fresh)
    assert listed(KeywordIndex(spark, index.path).search(queries, 5)) == listed(retrieval.keyword_search(now, queries, 5))


def test_keyword_index_of_nothing(spark, tmp_path):
    with_checkpoints(spark)
    index = KeywordIndex.built(spark.createDataFrame([], "id bigint, content string"), str(tmp_path / "k"))
    asked = spark.createDataFrame([(1, "a")], "query_id bigint, text string")
    assert index.search(asked, 3).count() == 0
    index.add(spark.createDataFrame([(5, "a b")], "id bigint, content string"))
    assert [r.id for r in index.search(asked, 3).collect()] == [5]

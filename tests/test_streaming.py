import datetime as dt
import json
import random
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import scoring
from loam.operators.embed import hash_embedded
from loam.plans.settings import Settings
from loam.sources import files
from loam.sources.store import StoredTable
from loam.sources.tables import with_checkpoints
from loam.streaming import streams


def test_gates_and_batches(spark):
    root = tempfile.mkdtemp()
    rows = [(i, "thanks" if i % 4 == 0 else "why?", "Done. ok" if i % 4 == 0 else "word " * (30 if i % 2 else 3), 0.9, "a fact") for i in range(40)]
    spark.createDataFrame(rows, "id bigint, user_msg string, answer string, score double, reply string").repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("id bigint, user_msg string, answer string, score double, reply string").parquet(f"{root}/in")
    streams.for_each_batch(streams.gated(stream), lambda df, i: df.write.mode("append").parquet(f"{root}/out"), f"{root}/check")
    got = {r.stage: r.n for r in spark.read.parquet(f"{root}/out").groupBy("stage").agg(F.count("*").alias("n")).collect()}
    assert got == {"pre_filter": 10, "length_filter": 10, "stored": 20}


def test_hits(spark):
    root = tempfile.mkdtemp()
    spark.sql("select id % 3 as memory_id, timestamp_seconds(1700000000 + id) as at from range(30)").write.parquet(f"{root}/in")
    stream = streams.hits(spark.readStream.schema("memory_id bigint, at timestamp").parquet(f"{root}/in"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hits_out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.memory_id: r.hits for r in spark.table("hits_out").collect()} == {0: 10, 1: 10, 2: 10}


def test_json_lines_and_uploads(spark):
    root = tempfile.mkdtemp()
    with open(f"{root}/log.jsonl", "w") as f:
        f.write('{"t": 1, "stage": "a"}\n\nnot json\n{"t": 3, "stage": "b"}\n{"t": 2, "stage": "c"}\n')
    assert [r.t for r in files.read_json_lines(spark, f"{root}/log.jsonl", "t int, stage string", 2, "t").collect()] == [3, 2]
    files.write_json_lines(spark.range(3), f"{root}/out")
    assert spark.read.json(f"{root}/out").count() == 3
    for name, text in (("a.md", "x" * 60), ("b.md", "short"), ("c.exe", "x" * 60)):
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    assert [r.path.rpartition("/")[2] for r in files.read_uploads(spark, root).collect()] == ["a.md"]


def test_typed_rows_with_bad_ones_counted(spark, tmp_path):
    lines = ['{"user_prompt": "a", "assistant_response": "b"}', "", "not json", '{"user_prompt": "c", "assistant_response": "d", "label": "noise", "more": 1}', "[1]", '{"user_prompt": {"x": 1}}', "{}", "3"]
    (tmp_path / "dataset.jsonl").write_text("\n".join(lines))
    rows, bad = files.read_rows(spark, str(tmp_path / "dataset.jsonl"), "dataset")
    assert [tuple(r)[::2] for r in rows.collect()][:2] == [("a", None), ("c", "noise")]
    assert [(r.lines, r.bad) for r in bad.collect()] == [(7, 7 - rows.count())] and 3 <= rows.count() <= 4
    assert [r.user_prompt for r in files.read_rows(spark, str(tmp_path / "dataset.jsonl"), "dataset", 1)[0].collect()] == ["a"]
    (tmp_path / "b.jsonl").write_text('{"index": 1, "stage": "stored", "latency_ms": 12}\n{"index": "x"}\n')
    rows, bad = files.read_rows(spark, str(tmp_path / "b.jsonl"), "benchmark")
    assert [(r["index"], r.stage, r.latency_ms) for r in rows.collect()] == [(1, "stored", 12)] and bad.first().bad == 1


def test_markdown_export_byte_for_byte(spark, tmp_path):
    with_checkpoints(spark)
    rows = [
        (1, "source:a|x", "first\nbody", 0.5, 3, "2024-01-01"), (2, "source:a|x", "second", 0.9, 0, "2024-01-02"), (3, None, "third", None, None, "2024-01-03"), (4, "", "fourth " * 20, 0.0, 1, "2024-01-01"), (5, "index", "fifth", 0.25, 1, "2024-02-01"),
    ]
    frame = spark.createDataFrame(rows, "id int, source string, content string, quality_score double, hit_count int, created_at string")
    path = tmp_path / "md"
    assert files.export_markdown(frame, str(path), "2024-06-01 12:00") == 3
    found = {f.name: f.read_text() for f in path.iterdir() if not f.name.startswith(".")}
    long = "fourth " * 20
    assert found == {
        "source-ax.md": "# source:a|x\n\n> 2 memories | exported 2024-06-01 12:00\n\n## 1. second\n\nsecond\n\n_quality: 0.90 | hits: 0 | created: 2024-01-02_\n\n---\n\n## 2. first\n\nfirst\nbody\n\n_quality: 0.50 | hits: 3 | created: 2024-01-01_\n\n---\n\n",
        "captured.md": f"# captured\n\n> 2 memories | exported 2024-06-01 12:00\n\n## 1. {long[:77]}...\n\n{long}\n\n_quality: 0.00 | hits: 1 | created: 2024-01-01_\n\n---\n\n## 2. third\n\nthird\n\n_quality: 0.00 | hits: 0 | created: 2024-01-03_\n\n---\n\n",
        "index.md": found["index.md"], "index-of-source.md": found["index-of-source.md"],
    }
    assert found["index.md"] == "# Knowledge Base Export\n\n> 5 memories across 3 sources | exported 2024-06-01 12:00\n\n## Sources\n\n- [captured](captured.md) (2 memories)\n- [index](index-of-source.md) (1 memories)\n- [source:a|x](source-ax.md) (2 memories)\n\n"
    assert not (tmp_path / "md.draft").exists()
    with pytest.raises(Exception):
        files.export_markdown(frame, str(path), "now")
    with pytest.raises(ValueError):
        files.export_markdown(frame, str(tmp_path / "none"), "now", 0.95)
    assert files.export_markdown(frame, str(tmp_path / "some"), "now", 0.5) == 1 and "> quality filter: >= 0.50\n\n## Sources" in (tmp_path / "some" / "index.md").read_text()


def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_streamed_texts_equal_the_batch_form(spark, tmp_path):
    rnd, start = random.Random(2), dt.datetime(2024, 1, 1)
    events, said = [], {}
    for m in range(12):
        texts = ["".join(rnd.choices("abc \n\"é", k=rnd.randrange(6))) for _ in range(rnd.randrange(1, 6))]
        rows = [{"type": "message_start"}, *({"type": "content_block_delta", "delta": {"type": "text_delta", "text": t}} for t in texts), {"type": "content_block_delta", "delta": {"type": "input_json_delta", "text": "no"}}, {"type": "message_stop"}]
        said[m] = "".join(texts)
        events += [(m, i, json.dumps(r), start + dt.timedelta(seconds=rnd.randrange(30))) for i, r in enumerate(rows) if (m, i) != (3, 1)]
    said[3] = "".join(json.loads(d)["delta"]["text"] for m, i, d, _ in events if m == 3 and "text_delta" in d)
    rnd.shuffle(events)
    events += rnd.sample(events, 5)  # some come twice
    late = [(99, 0, "{}", start + dt.timedelta(hours=2)), (99, 1, '{"type": "message_stop"}', start + dt.timedelta(hours=2))]
    kind = "message bigint, place bigint, data string, at timestamp"
    for i, part in enumerate([events[:25], events[25:50], events[50:], late, [(5, 9, '{"delta": {"type": "text_delta", "text": "too late"}}', start + dt.timedelta(hours=2))]]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    rocks(spark)
    try:
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        texts = streams.streamed_texts(streams.text_pieces(stream), 60)
        texts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [(r.message, r.said, r.complete) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.message < 99]
    assert sorted(got)[: len(said)] == sorted((m, t, m != 3) for m, t in said.items())
    batch = streams.joined_pieces(streams.text_pieces(spark.createDataFrame(events, kind)))
    assert {r.message: r.said for r in batch.collect()} == said


def test_prototypes_change_under_a_running_gate(spark, tmp_path):
    with_checkpoints(spark)
    embed = lambda rows: hash_embedded(rows, 64)
    settings = Settings(rebuild_every=10, noise_prototypes=8, pre_gate=0.4, ingest_bytes=30)
    first = [(i, "good", t) for i, t in enumerate(scoring.GOOD)] + [(100 + i, "noise", t) for i, t in enumerate(scoring.NOISE)]
    table = StoredTable.created(spark.createDataFrame(first, "id bigint, kind string, text string"), str(tmp_path / "p"), buckets=4)
    kind = "id bigint, user_msg string, answer string, reply string"
    batches = [[(100 * n + i, "why is it so?", "short" if i % 2 else f"the quarterly zebra report number {i} says nothing much at all in batch {n}", "a fact") for i in range(24)] for n in range(3)]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.learning_gate(stream, table.path, str(tmp_path / "out"), embed, str(tmp_path / "check"), settings).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 72

    def plain(answers, noise):
        vectors = {t: np.asarray(r["embedding"], float) for r in embed(spark.createDataFrame([(t,) for t in {*answers, *scoring.GOOD, *noise}], "text string")).collect() for t in [r["text"]]}
        like = lambda a, b: 0.0 if not (n := np.linalg.norm(vectors[a]) * np.linalg.norm(vectors[b])) else float(vectors[a] @ vectors[b]) / n
        q = {a: np.mean([like(a, p) for p in scoring.GOOD]) for a in answers}
        n = {a: np.mean(sorted((like(a, p) for p in noise), reverse=True)[:3]) for a in answers}
        return {a: 0.5 if q[a] + n[a] <= 0 else min(1.0, max(0.0, q[a] / (q[a] + n[a]))) for a in answers}

    noise, rejected, count, version = list(scoring.NOISE), [], 0, 0
    for n in range(3):
        here = sorted((r for r in out if r.batch == n), key=lambda r: r.id)
        want = plain([r.answer for r in here], noise)
        assert all(abs(r.content_score - want[r.answer]) < 1e-6 and r.scorer == version for r in here)
        before, rejected = count, rejected + [r for r in here if r.stage != "stored"]
        count = len(rejected)
        if count // 10 > before // 10:
            noise, version = [r.answer[:500] for r in sorted(rejected, key=lambda r: (-r.batch, -r.id))[:8]], version + 1
    assert version == 3 and StoredTable(spark, table.path).version == 3


def test_rejection_log_signals(spark):
    root = tempfile.mkdtemp()
    rows = [(i, "a" if i % 3 else "b", f"rejected {i}") for i in range(90)]
    frame = spark.createDataFrame(rows, "id bigint, log string, answer string").coalesce(1)
    for part in (frame.filter("id < 45"), frame.filter("id >= 45")):
        part.write.mode("append").parquet(f"{root}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("id bigint, log string, answer string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        signals = streams.rejection_signals(stream, most=40, every=25)
        query = signals.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(f"{root}/out").collect()
    by = {k: (sum(r.signals for r in got if r.log == k), max(r.seen for r in got if r.log == k)) for k in ("a", "b")}
    assert by == {"a": (2, 60), "b": (1, 30)} and all(r.kept <= 40 for r in got)

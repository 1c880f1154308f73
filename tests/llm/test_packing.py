import json
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loam.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_the_tokenizer(tokenizer, tmp_path):
    own = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.fast
    texts = ["", " ", "a", " a", "a ", "a  b", "a \n b", "\n\n x\ty", "it's  we'll don't I'LL", "é ü  x  y", "<|endoftext|> a <|endoftext|>", "12 3.4, (x) [y]\r\n", "x\x1c y \x1cz", "日本 語 👍 a", "word, word. word word?! (x), 's. it's, 3. 4, ...\n, a.\nb, Ǆ. ª, x²."]
    texts += [" " * 100_000 + "x", "ab" * 100_000, "".join(map(chr, range(1, 0x3000)))]
    for t in texts:
        assert own.encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    # A file whose ids don't follow its merges goes to the library that it is written for.
    spec = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    vocabulary = spec["model"]["vocab"]
    first, second = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"][:2])
    vocabulary[first], vocabulary[second] = vocabulary[second], vocabulary[first]
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other = packing.Encoder(str(tmp_path / "other.json"))
    assert not other.fast and other.encode(" the").tolist() == Tokenizer.from_file(str(tmp_path / "other.json")).encode(" the").ids


@pytest.mark.parametrize("kind", [" ", "\n", " \n", "\t", "\xa0", "\u3000", "a", "7", ".", "é"])
def test_endless_runs(kind, tokenizer):
    own = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    run = kind * (2_000_000 // len(kind))
    assert len(own.encode(run)) and len(own.encode(f"w{run}w")) > 2
    for n in (998, 999, 1000, 1001, 2500):
        for text in (kind * n, f"a{kind * n}", f"{kind * n}b", f"a {kind * n}'s", f"{kind * n}<|endoftext|>{kind * n}.{kind * n}"):
            assert own.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_table_with_an_endless_run(spark):
    docs = spark.createDataFrame([(1, " " * 2_000_000), (2, "x")], "doc_id bigint, text string")
    assert sum(r["length"] for r in packing.pack(docs).collect()) == len(packing.encoder(None).encode(" " * 2_000_000)) + len(packing.encoder(None).encode("x")) + 2


def least_sequences(lengths, capacity=2048):
    """A lower bound (Martello and Toth): what is longer than half must be alone with what is short enough to join it."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(n > capacity - k for n in lengths)
        half = [n for n in lengths if capacity / 2 < n <= capacity - k]
        short = sum(n for n in lengths if k <= n <= capacity / 2)
        best = max(best, alone + len(half) + max(0, -(-(short - (len(half) * capacity - sum(half))) // capacity)))
    return best


@pytest.mark.parametrize("histogram", [{}, {5: 1}, {2048: 10}, {1: 5000}, {1000: 7, 1048: 7}, {n: 3 for n in range(1, 2049, 7)}])
def test_plan_places_everything_once(histogram):
    plan = packing.plan_sequences(histogram)
    room, seen = defaultdict(list), defaultdict(int)
    for n, first, pieces, each, sequence, offset in plan:
        assert first == seen[n]
        seen[n] += pieces
        for i in range(pieces):
            room[sequence + i // each].append((offset + i % each * n, n))
    assert dict(seen) == histogram
    for places in room.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 2048
    least = least_sequences([n for n, c in histogram.items() for _ in range(c)])
    assert least <= len(room) <= least + 1


def test_program_places_nearly_all(sf_dir):
    """Over the lengths of 10,000 documents the rounded program places nine tenths at least, within its gap, and no sequence is wasted."""
    own, histogram = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for text in pq.read_table(Path(sf_dir).parent / "sf0.1/documents.parquet", columns=["text"])["text"].to_pylist():
        n = len(own.encode(text or "")) + 1
        histogram.update([n - (n - 1) // 2048 * 2048] + [2048] * ((n - 1) // 2048))
    columns, left, gap = packing.program_columns(histogram, 2048)
    placed = Counter()
    for column, times in columns:
        assert packing.filled(column) <= 2048
        placed.update({n: copies * times for n, copies in column.items()})
    assert placed + Counter(left) == histogram and gap <= 0.01
    assert placed.total() >= 0.9 * histogram.total()
    used = sum(times for _, times in packing.best_fit(left, 2048, columns))
    assert used == -(-sum(n * c for n, c in histogram.items()) // 2048)


def test_whole_table(spark, sf_dir, tokenizer):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == docs.keys()
    for doc, text in docs.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert sum(p.length for p in pieces) == len(ids) and all(p.length == 2048 for p in pieces[1:]) and pieces[0].length <= 2048
        for p in pieces:
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for places in by_sequence.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 2048
    assert len(by_sequence) <= least_sequences([r.length for r in rows]) + 1


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "same text", "z"), (3, "same text", "z")], "doc_id bigint, text string, sequence_id string")
    rows = packing.pack(docs).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4 and {r.length for r in rows if r.doc_id < 3} == {1}
    assert packing.pack(docs.limit(0)).count() == 0

"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, held against every
window of every document; hits are verified word by word; documents or the words that were hit are removed.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A window is `width` words of an
item; an item of fewer words, but not none, is one window.

The set is broadcast in blocks of at most MAX_WINDOWS windows, whatever the benchmark's size; documents pass
each block in turn. Null or empty texts have no words and stay clean; an item without words is ignored; items
with equal text are each counted; one without an id goes by the id `None`; repeated documents are judged each by itself; without items nothing is hit;
input columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import repeat

from pyspark.sql import DataFrame, functions as F

from .common import ddl, keeps_columns, map_texts, staged, utf8_column, with_computed

MAX_WINDOWS = 200_000
#: Lower-cases A-Z and turns what is in no word into spaces.
WORD_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def item_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """window (words joined by spaces), length and the item_ids (strings) that have it, a row for each different window."""

    def cut(parts):
        for part in parts:
            ids, windows, lengths = [], [], []
            for item, text in zip(part.column("item_id").to_pylist(), utf8_column(part, "text")):
                words = words_of(text)
                n = min(width, len(words))
                for i in range(len(words) - n + 1 if n else 0):
                    ids.append(str(item))
                    windows.append(b" ".join(words[i : i + n]).decode())
                    lengths.append(n)
            yield [ids, windows, lengths]

    rows = map_texts(benchmark.select("item_id", "text"), ddl("item string, window string, length int"), cut)
    return rows.groupBy("window", "length").agg(F.collect_set("item").alias("items"))


class WindowSet:
    """Word windows of a block, ready to be searched: a rolling hash finds candidates, a look-up of the words confirms them."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        import numpy as np

        self.ids: dict[bytes, int] = {}
        self.exact: dict[tuple[int, ...], list[str]] = {}
        for window, items in windows:
            self.exact[tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in window.encode().split())] = items
        by_length: dict[int, list] = {}
        for key in self.exact:
            by_length.setdefault(len(key), []).append(key)
        self.hashes = {n: np.unique(self.rolling(np.array(keys, np.uint64).reshape(len(keys), n).ravel(), n)[::n]) for n, keys in by_length.items()}

    @staticmethod
    def rolling(ids, n):
        """A hash of each run of n ids; numpy's integers wrap."""
        import numpy as np

        out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - n + 1 + i]
        return out ^ (out >> np.uint64(29))

    def search(self, ids) -> list[tuple[int, int, list[str]]]:
        """(place, length, items) of each window in a sequence of word ids; 0 is a word that no window has."""
        import numpy as np

        found = []
        known = ids != 0
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            upto = np.concatenate([[0], np.cumsum(known)])
            at = np.flatnonzero(upto[n:] - upto[:-n] == n)
            if not len(at):
                continue
            rolled = self.rolling(ids, n)[at]
            for i in at[hashes[np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)] == rolled].tolist():
                items = self.exact.get(tuple(ids[i : i + n].tolist()))
                if items is not None:
                    found.append((i, n, items))
        return found


def summary(at: list[int], length: list[int], items: list[str]) -> tuple:
    """n_hit, n_items, items_sha256, contaminated and hits of a document, from its window hits."""
    runs: list[list[int]] = []
    for start, n in sorted(zip(at, length)):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + n)
        else:
            runs.append([start, start + n])
    which = sorted(set(items))
    return sum(b - a for a, b in runs), len(which), hashlib.sha256(",".join(which).encode()).hexdigest(), bool(runs), [{"from": a, "to": b} for a, b in runs]


SUMMARY = "n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hits array<struct<from: int, to: int>>"


def scan_block(docs: DataFrame, block, last: bool) -> DataFrame:
    """docs with n_words and window hits (place, length, item), added to those of earlier blocks; after the last block their summary in place of the hits."""
    made: list[WindowSet] = []
    fields = ddl(f"n_words bigint, {SUMMARY if last else 'hit_at array<int>, hit_length array<int>, hit_items array<string>'}")
    had = "hit_at" in docs.columns
    source = docs.withColumnsRenamed({"hit_at": "had_at", "hit_length": "had_length", "hit_items": "had_items"}) if had else docs

    def compute(part):
        import numpy as np

        if not made:
            made.append(WindowSet(block.value))
        windows, counts, ids = made[0], [], array("Q")
        for text in utf8_column(part, "text"):
            words = words_of(text)
            counts.append(len(words))
            ids.extend(map(windows.ids.get, words, repeat(0)))
            ids.append(0)  # no window reaches into the next text
        starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
        at, length, items = ([[] for _ in counts] for _ in range(3))
        if had:
            at, length, items = (part.column(c).to_pylist() for c in ("had_at", "had_length", "had_items"))
        for place, n, which in windows.search(np.frombuffer(ids, np.uint64)):
            row = int(np.searchsorted(starts, place, side="right")) - 1
            for item in which:
                at[row].append(place - int(starts[row]))
                length[row].append(n)
                items[row].append(item)
        return [counts, *zip(*map(summary, at, length, items))] if last else [counts, at, length, items]

    return with_computed(source, fields, compute).drop("had_at", "had_length", "had_items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with RESULT's columns and hits, an array of the runs of words that were hit: from word, to word (exclusive)."""
    windows = staged(item_windows(benchmark, width), "windows")
    blocks = max(1, -(-windows.count() // max_windows))
    keyed = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    # The columns of docs get names of their own meanwhile, so that none is taken for one of the scan's.
    results = ["n_words", *ddl(SUMMARY).names]
    names = {c: c if c == "text" else f"aside_{i}_of_input" for i, c in enumerate(docs.columns) if c not in results}
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    for i in range(blocks):
        rows = keyed.filter(F.col("block") == i).select("window", "items").collect()
        out = scan_block(out, docs.sparkSession.sparkContext.broadcast([(r.window, r["items"]) for r in rows]), i + 1 == blocks)
        if i + 1 < blocks:
            out = staged(out, "scanned")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *results)


@keeps_columns
def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without the words that were hit; the columns stay as they are."""
    found = find_contamination(docs.select(*docs.columns), benchmark, width)
    if remove == "documents":
        return found.filter(~F.col("contaminated")).select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove is documents or spans")

    def compute(part):
        import re

        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        out = []
        for text, runs, is_null in zip(utf8_column(part, "text"), part.column("hits").to_pylist(), part.column("text").is_null().to_pylist()):
            places = [m.span() for m in word.finditer(text)] if runs else []
            for run in reversed(runs):
                text = text[: places[run["from"]][0]] + text[places[run["to"] - 1][1] :]
            out.append(None if is_null else text.decode())
        return [out]

    cleaned = with_computed(found, ddl("clean string"), compute).withColumn("text", F.col("clean"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)

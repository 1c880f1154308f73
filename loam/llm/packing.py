"""Best-fit packing of documents into sequences of fixed length.

How many pieces there are of each length is all that packing depends on, and there are at most `capacity`
lengths. So Spark counts the lengths, the configuration linear program over that histogram is solved on the
driver whatever the number of documents, and Spark gives each piece its place: the r-th piece of a length goes
where the plan puts the r-th piece of that length.

The program (columns: ways to fill a sequence; rows: pieces of each length) is solved by multiplicative
weights: lengths that lag behind gain weight, and a knapsack by dynamic programming prices the columns. Each
round's prices also bound from below how few sequences any packing needs. The solution's fractional uses are
rounded to whole ones, the program is solved again for the pieces that are left, and so on; the few that no
rounded column takes are packed best fit, longest first.

Null and empty texts are one token (the end); long texts are cut, first piece shortest; repeated rows are
packed each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib

from pyspark.sql import DataFrame, Window, functions as F

from .common import ddl, map_texts, process_cache, staged, text_column

END = 0
# Fixed value: how the byte-level tokenizer cuts a text before it merges bytes.
#: White space as the pattern knows it, in runs that it would take long over.
LONG_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_ranks(vocabulary: dict[str, int], merges: list) -> dict[bytes, int] | None:
    """The bytes of each token with its id, where ids follow the order of the merges (single bytes first); else None."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printed)]
    byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(hidden)}
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
    tokens = [t for t, _ in sorted(vocabulary.items(), key=lambda x: x[1])]
    if tokens[256 : 256 + len(joined)] != joined or not set(tokens[:256]) == set(byte_of):
        return None
    return {bytes(byte_of[c] for c in t): i for i, t in enumerate(tokens[: 256 + len(joined)])}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    A byte-level tokenizer file whose ids follow its merges says the same as a table of ranks, which the faster of
    two public tokenizer libraries takes; any other file goes to the library that it was written for.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and not spec.get("normalizer")
        level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        ranks = merge_ranks(model["vocab"], model["merges"]) if model.get("type") == "BPE" and plain and level else None
        added = spec.get("added_tokens", [])
        self.special = tuple(t["content"] for t in added)
        if ranks and not any(t[x] for t in added for x in ("single_word", "lstrip", "rstrip", "normalized")):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.fast, self.tokenizer = None, Tokenizer.from_file(path)

    def encode(self, text: str):
        import numpy as np

        if self.fast:
            parts, done = [], 0
            # The pattern can't take endless white space. It makes a word of all but a run's last character, which
            # goes with what follows, and of the whole run where the text ends or is cut by a special token.
            for run in LONG_WHITE.finditer(text):
                end = run.end() - (run.end() < len(text) and not text.startswith(self.special, run.end()))
                parts += [self.encode_words(text[done : run.start()]), np.array(self.fast._encode_single_piece(text[run.start() : end]), "<u4")]
                done = end
            return np.concatenate([*parts, self.encode_words(text[done:])]) if parts else self.encode_words(text)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


    def encode_words(self, text: str):
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    made = process_cache("encoders")
    if path not in made:
        made[path] = Encoder(path)
    return made[path]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document's ids."""

    def compute(parts):
        import numpy as np

        own = encoder(tokenizer_path)
        end = np.array([END], "<u4")
        for part in parts:
            rows = [[] for _ in range(5)]
            for doc, text in zip(part.column("doc_id").to_pylist(), text_column(part, "text")):
                ids = np.concatenate([own.encode(text), end])
                n = len(ids)
                first = n - (n - 1) // capacity * capacity
                for piece, (a, b) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity))):
                    for column, value in zip(rows, (doc, piece, a, b - a, zlib.crc32(ids[a:b]))):
                        column.append(value)
            yield rows

    return map_texts(docs.select(F.col("doc_id").cast("bigint"), "text"), ddl(PIECES), compute)


class Knapsack:
    """What fills a sequence best under prices of lengths; a length may come many times."""

    def __init__(self, lengths, prices, capacity: int):
        import numpy as np

        self.capacity = capacity
        dense = np.full(capacity + 1, -np.inf)
        dense[lengths] = prices
        room = np.zeros(capacity + 1)  # room[capacity - c]: the value of c tokens' room; so each step reads two runs of neighbours
        took = np.zeros(capacity + 1, np.int64)
        for c in range(int(lengths[0]), capacity + 1):
            value = room[capacity - c + 1 :] + dense[1 : c + 1]
            length = int(value.argmax())
            room[capacity - c], took[c] = value[length], length + 1
        self.took = took.tolist()
        self.with_each = prices + room[lengths]  # the value of the best column that has a length

    def column(self, lead: int) -> dict[int, int]:
        """{length: copies} of the best column that has that length."""
        found, c = {lead: 1}, self.capacity - lead
        while self.took[c]:
            found[self.took[c]] = found.get(self.took[c], 0) + 1
            c -= self.took[c]
        return found


def filled(column: dict[int, int]) -> int:
    return sum(n * copies for n, copies in column.items())


def solve_program(histogram: dict[int, int], capacity: int, gap: float = 0.01, full: float = 0.995, steps: int = 25, each: int = 64, slack: float = 0.01, rate: float = 2.0, favour: float = 1.1) -> tuple[list[tuple[dict[int, int], float]], float]:
    """(column, uses) with fractional uses that together hold every piece, and a lower bound of the program's value.

    A column is {length: copies}. Prices start as the share of a sequence that a length takes, the program's dual
    where sequences can be filled, to the power favour: of columns alike, those with long pieces come first. Each
    is multiplied by a weight that grows with the share of the length's pieces that still wait. A round uses the
    best columns of up to `each` lengths, those within slack of the best of all, for a 1 / steps of all sequences.
    Any prices prove a bound: the pieces' worth over the best column's. Rounds end when the value, with what still
    waits in sequences of one length each, is within gap of the bound, or when no length has a `full` column any more.
    """
    import numpy as np

    every = lengths = np.array(sorted(histogram), np.int64)
    there, left = np.zeros(capacity + 1), np.zeros(capacity + 1)
    there[every] = left[every] = [histogram[int(x)] for x in every]
    total = float(every @ there[every]) / capacity
    found, value, bound = {}, 0.0, total  # no sequence holds more than its capacity
    while True:
        lengths = lengths[left[lengths] > 1e-6 * there[lengths]]
        alone = left[every] / (capacity // every)
        if value + float(alone.sum()) <= (1 + gap) * bound or not len(lengths):
            break
        share = left[lengths] / there[lengths]
        prices = (lengths / capacity) ** favour * np.exp(rate * (share - share.mean()))
        best = Knapsack(lengths, prices, capacity)
        most = float(best.with_each.max())
        bound = max(bound, float(prices @ there[lengths]) / most)
        leads = np.argsort(-best.with_each, kind="stable")[:each]
        leads = lengths[leads[best.with_each[leads] >= (1 - slack) * most]].tolist()
        used = False
        for lead in leads:
            column = {n: min(copies, int(there[n])) for n, copies in best.column(lead).items()}
            uses = min(total / steps / len(leads), *(left[n] / copies for n, copies in column.items()))
            if uses > 0 and filled(column) >= full * capacity:
                for n, copies in column.items():
                    left[n] = max(0.0, left[n] - uses * copies)
                key = tuple(sorted(column.items()))
                found[key] = found.get(key, 0.0) + uses
                value, used = value + uses, True
        if not used:  # these lengths fill no sequence with what waits
            lengths = np.setdiff1d(lengths, leads)
    columns = [(dict(k), v) for k, v in found.items()]
    return columns + [({n: capacity // n}, uses) for n, uses in zip(every.tolist(), alone.tolist()) if uses], bound


def best_fit(histogram: dict[int, int], capacity: int, begun: list[tuple[dict[int, int], int]]) -> list[tuple[dict[int, int], int]]:
    """(contents, sequences) by best fit, longest first, on top of sequences begun; those with equal contents are kept as one, so the work doesn't grow with the counts."""
    open_: dict[int, list[list]] = {}  # by room: [contents, number of sequences]
    for contents, number in begun:
        open_.setdefault(capacity - filled(contents), []).append([contents, number])
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n > 0:
            room = next((r for r in range(length, capacity + 1) if open_.get(r)), None)
            if room is None:
                copies = capacity // length
                whole, rest = divmod(n, copies)
                if whole:
                    open_.setdefault(capacity - copies * length, []).append([{length: copies}, whole])
                if rest:
                    open_.setdefault(capacity - rest * length, []).append([{length: rest}, 1])
                break
            contents, number = open_[room].pop()
            copies = min(room // length, n)
            fits = min(number, n // copies)
            if fits < number:
                open_[room].append([contents, number - fits])
            open_.setdefault(room - copies * length, []).append([contents | {length: copies + contents.get(length, 0)}, fits])
            n -= copies * fits
    return [(contents, number) for groups in open_.values() for contents, number in groups if number]


def round_program(columns: list[tuple[dict[int, int], float]], left: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """(column, whole uses): the whole part of each use, then one more in order of the fractions, as far as there are pieces. Takes them from left."""
    groups = []
    for whole in (True, False):
        for column, uses in sorted(columns, key=lambda x: (-(x[1] % 1), -len(x[0]), sorted(x[0].items()))):
            times = min(int(uses + 1e-9) if whole else 1, *(left[n] // copies for n, copies in column.items()))
            if times > 0:
                groups.append((column, times))
                for n, copies in column.items():
                    left[n] -= copies * times
    return groups


def program_columns(histogram: dict[int, int], capacity: int, least_share: float = 0.1, full: float = 0.995) -> tuple[list[tuple[dict[int, int], int]], dict[int, int], float]:
    """(column, sequences) placed by the program, the pieces of each length that it leaves, and by what share the first solution's value is over its lower bound.

    The program is solved and rounded again for what the last rounding left, as long as that places
    least_share of it. Columns that fill less than `full` of a sequence are left to best fit.
    """
    left, groups, gap = {n: count for n, count in histogram.items() if count}, [], None
    while left:
        columns, bound = solve_program(left, capacity, full=full)
        gap = sum(uses for _, uses in columns) / bound - 1 if gap is None else gap
        before = sum(left.values())
        groups += round_program([x for x in columns if filled(x[0]) >= full * capacity], left)
        left = {n: count for n, count in left.items() if count}
        if before - sum(left.values()) < least_share * before:
            break
    return groups, left, gap or 0.0


def plan_sequences(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, pieces, each, sequence, offset): pieces first to first + pieces - 1 of a length go `each` to a sequence, from that sequence and offset on."""
    columns, left, _ = program_columns(histogram, capacity)
    given, rows, sequence = dict.fromkeys(histogram, 0), [], 0
    for contents, number in best_fit(left, capacity, columns):
        offset = 0
        for n, copies in sorted(contents.items(), reverse=True):
            rows.append((n, given[n], copies * number, copies, sequence, offset))
            given[n] += copies * number
            offset += n * copies
        sequence += number
    return rows


def ranked_pieces(pieces: DataFrame, histogram: dict[int, int], rows_each: int = 2_000) -> DataFrame:
    """pieces with rank: 0, 1, ... within each length. A length with more than rows_each pieces is split into groups, so that a frequent one is no single task's."""
    parts = pieces.sparkSession.createDataFrame([(n, -(-count // rows_each)) for n, count in sorted(histogram.items())], "length bigint, parts bigint")
    group = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("parts")).cast("int")
    grouped = pieces.join(F.broadcast(parts), "length").withColumn("part", group).drop("parts")
    counts = grouped.groupBy("length", "part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    return grouped.withColumn("inside", inside).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def pack(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = staged(cut_pieces(docs, capacity, tokenizer_path), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    spark = docs.sparkSession
    plan = spark.sparkContext.broadcast(plan_sequences(histogram, capacity))
    made: dict[int, tuple] = {}

    def place(batches):
        import numpy as np
        import pyarrow as pa

        if not made:
            by_length: dict[int, list] = {}
            for row in plan.value:
                by_length.setdefault(row[0], []).append(row[1:])
            made.update({n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, rows in by_length.items()})
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                first, _, each, start, shift = made[n]
                i = np.searchsorted(first, rank[rows], side="right") - 1
                where = rank[rows] - first[i]
                sequence[rows] = start[i] + where // each[i]
                offset[rows] = shift[i] + where % each[i] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked_pieces(pieces, histogram).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("bigint")).mapInArrow(place, ddl(f"{PIECES}, sequence_id bigint, offset bigint"))

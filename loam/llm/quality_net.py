"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Every word has a sparse random index vector, drawn from its hash, and a vector of its own: the sum of the index vectors
of the words beside it, over all documents, at unit length. A word has one once it was seen LEAST times; no two words
share one. A document is the mean of its words' vectors, that mean's length (near 1 where a text says one thing over
and over), the share of words without a vector, and the logarithm of their number. A network of two layers, trained in
numpy on at most `most_labelled` labelled documents (those of least hash), gives a logit; a temperature fitted on a
fifth of them makes its probabilities honest.

The vectors of the `most_sent` most frequent words (72 bytes each) are broadcast; all others reach the documents by a
shuffle of words. Which way a vector comes changes no score.

Null and empty texts, and texts without words, have the zero vector and the score that the network gives it;
rows are scored each by itself; labels of a document that differ count as the higher one, null labels not at
all; without labels of both kinds every score is the share of label 1, 0.5 without any; an empty table gives
no rows; language, source, labels and doc_id are no inputs of a score; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from .common import ddl, map_texts, process_cache, staged, text_column
from .lm_score import most_common

DIM, NONZERO, LEAST = 32, 4, 5
INPUTS = DIM + 3
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
#: Most words that a process remembers, and their most letters.
MAX_CACHED, MAX_LETTERS = 400_000, 64
MOST_SENT, DENSE = 1_000_000, 32_768
#: Words and codes that a task holds before it hands them on.
HELD = 1_000_000
NO_CODE = 0xFFFFFFFF  # codes have 24 bits
SLICE_BYTES = 2 << 20  # of text at a time


def word_hash(word: str) -> int:
    """Words are told apart in lower case, but words all in capitals from others. 64 bits, signed."""
    import xxhash

    shaped = f"^{word.lower()}" if len(word) > 1 and word.isupper() else word.lower()
    return xxhash.xxh3_64_intdigest(shaped.encode()) - (1 << 63)


def hashes_of(texts: list[str]):
    """(hashes, counts): the hashes of all words of all texts, and how many each text has."""
    import numpy as np

    known = process_cache("word_hashes")
    words, counts = [], []
    for text in texts:
        own = TOKEN.findall(text)
        counts.append(len(own))
        words += own
    fresh = set(words) - known.keys()
    if len(known) + len(fresh) > MAX_CACHED:
        known.clear()
        fresh = set(words)
    known.update((w, word_hash(w)) for w in fresh)
    found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    for w in fresh:
        if len(w) > MAX_LETTERS:
            del known[w]
    return found, np.array(counts, np.int64)


def different_words(hashes):
    """(different, place): each hash once, and where each word's is; by hashing, which costs less than sorting."""
    import pyarrow as pa

    coded = pa.array(hashes).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)


def index_code(hashes):
    """The index vector of each word in 24 bits: NONZERO places of five bits and their signs."""
    return ((hashes >> 7) & 0xFFFFFF).astype("uint32")


def code_parts(codes):
    """(place, sign) arrays for each of the NONZERO places of codes."""
    return [((codes >> (5 * i)) & (DIM - 1), 1.0 - 2.0 * ((codes >> (5 * NONZERO + i)) & 1)) for i in range(NONZERO)]


def binaries(values, starts):
    """An Arrow column of the bytes of values, cut at starts (the first is 0)."""
    import numpy as np
    import pyarrow as pa

    raw = np.ascontiguousarray(values)
    offsets = (np.append(starts, len(raw)) * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def word_contexts(docs: DataFrame) -> DataFrame:
    """word, n (how often it was seen), codes (of the words beside it) and sums (of their index vectors), in part. Of words that are frequent where a task begins it keeps sums, of all others codes."""

    def compute(parts):
        import numpy as np
        import pyarrow as pa

        dense, total, seen = None, None, None
        held, size = [], 0

        def given():
            """A row for each word held: n, and the codes, of which the first of each occurrence's share of the text is none."""
            w, c, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(w, kind="stable")
            w, c, n = w[order], c[order], n[order]
            starts = np.flatnonzero(np.diff(w, prepend=w[0] - 1))
            has = c != NO_CODE
            kept = np.concatenate([[0], np.cumsum(has)])[starts]
            return [pa.array(w[starts]), pa.array(np.add.reduceat(n, starts)), binaries(c[has], kept), pa.nulls(len(starts), pa.binary())]

        for part in parts:
            hashes, counts = hashes_of(text_column(part, "text"))
            if not len(hashes):
                continue
            different, place = different_words(hashes)
            times = np.bincount(place, minlength=len(different))
            if dense is None:
                dense = np.sort(different[np.argsort(-times, kind="stable")[:DENSE]])
                total, seen = np.zeros(len(dense) * DIM), np.zeros(len(dense), np.int64)
            at = np.minimum(np.searchsorted(dense, different), max(0, len(dense) - 1))
            row = np.where(dense[at] == different, at, -1) if len(dense) else np.full(len(different), -1)
            inside = row >= 0
            seen[row[inside]] += times[inside]
            rest = np.flatnonzero(~inside)
            held.append((different[rest], np.full(len(rest), NO_CODE, np.uint32), times[rest]))
            ends = np.cumsum(counts)
            beside = np.ones(len(hashes) - 1, bool)
            beside[ends[(ends > 0) & (ends < len(hashes))] - 1] = False  # no word sees another text
            a, b = place[:-1][beside], place[1:][beside]
            own, other = np.concatenate([a, b]), np.concatenate([b, a])
            code, summed = index_code(different), inside[own]
            base, parts_of = row[own[summed]] * DIM, code_parts(code[other[summed]])
            total += np.bincount(np.concatenate([base + where for where, _ in parts_of]), np.concatenate([sign for _, sign in parts_of]), len(total))
            own, other = own[~summed], other[~summed]
            held.append((different[own], code[other], np.zeros(len(own), np.int64)))
            size += len(rest) + len(own)
            if size > HELD:
                yield given()
                held, size = [], 0
        if size:
            yield given()
        if dense is not None and len(dense):
            yield [pa.array(dense), pa.array(seen), pa.nulls(len(dense), pa.binary()), binaries(total.astype(np.int32), np.arange(len(dense)) * DIM)]

    return map_texts(docs.select("text"), ddl("word bigint, n bigint, codes binary, sums binary"), compute, most=SLICE_BYTES)


def word_vectors(contexts: DataFrame) -> DataFrame:
    """word, n and vector (half-precision bytes, unit length or zeros) of word_contexts: each word's rows stand together in a sorted partition and are added up batch by batch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, pending, times = None, np.zeros(DIM), 0

        def rows(words, n, sums):
            unit = sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64)), binaries(unit.astype(np.float16).ravel(), np.arange(len(words)) * DIM)], names=["word", "n", "vector"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words, place = np.unique(batch.column("word").to_numpy(), return_inverse=True)
            total, n = np.zeros(len(words) * DIM), np.bincount(place, batch.column("n").to_numpy(), len(words))
            codes, dense = batch.column("codes").to_pylist(), batch.column("sums").to_pylist()
            lengths = np.array([len(c) // 4 if c else 0 for c in codes])
            own = np.repeat(place, lengths) * DIM
            for where, sign in code_parts(np.frombuffer(b"".join(c for c in codes if c), np.uint32)):
                total += np.bincount(own + where, sign, len(total))
            total = total.reshape(-1, DIM)
            full = [i for i, d in enumerate(dense) if d]
            if full:
                np.add.at(total, place[full], np.frombuffer(b"".join(dense[i] for i in full), np.int32).reshape(-1, DIM))
            if last is not None:
                if words[0] == last:
                    total[0] += pending
                    n[0] += times
                else:
                    yield rows(np.array([last]), np.array([times]), pending[None])
            if len(words) > 1:
                yield rows(words[:-1], n[:-1], total[:-1])
            last, pending, times = words[-1], total[-1], n[-1]
        if last is not None:
            yield rows(np.array([last]), np.array([times]), pending[None])

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(run, ddl("word bigint, n bigint, vector binary"))


def sent_table(vectors: DataFrame):
    """(words, vectors) in order of hash, at half precision: at most MOST_SENT rows."""
    import numpy as np

    rows = vectors.toArrow()
    if not rows.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, DIM), np.float16)
    words = rows["word"].to_numpy()
    found = np.frombuffer(b"".join(rows["vector"].to_pylist()), np.float16).reshape(-1, DIM)
    order = np.argsort(words)
    return words[order], found[order]


def words_without(different, place, there) -> list[dict]:
    """The words of a text that have no vector there, and how often each is in it."""
    import numpy as np

    own, times = np.unique(place[~there[place]], return_counts=True)
    return [{"word": int(w), "times": int(n)} for w, n in zip(different[own], times)]


def summed_documents(docs: DataFrame, sent, complete: bool) -> DataFrame:
    """doc_id, digest (of the text), n (words), known (words whose vector was sent), sums (of their vectors, as bytes) and, unless complete, others: the words without, and how often each is there."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")

    def compute(parts):
        import numpy as np

        words, vectors = sent.value
        for part in parts:
            hashes, counts = hashes_of(text_column(part, "text"))
            different, place = different_words(hashes)
            at = np.minimum(np.searchsorted(words, different), max(0, len(words) - 1))
            row = np.where(words[at] == different, at, -1) if len(words) else np.full(len(different), -1)
            own = np.zeros((len(different), DIM), np.float32)
            there = row >= 0
            own[there] = vectors[row[there]]
            doc = np.repeat(np.arange(len(counts)), counts)
            sums = np.zeros((len(counts), DIM))
            for i in range(0, len(place), 1 << 16):  # bounds the memory for one very long text, too
                mine = doc[i : i + (1 << 16)]
                starts = np.flatnonzero(np.diff(mine, prepend=-1))
                sums[mine[starts]] += np.add.reduceat(own[place[i : i + (1 << 16)]], starts, axis=0)
            known = np.bincount(doc, there[place], len(counts)).astype(np.int64).tolist()
            others = [[]] * len(counts) if complete else [words_without(different, place[end - n : end], there) for end, n in zip(np.cumsum(counts), counts)]
            yield [part.column("doc_id"), part.column("digest"), counts.tolist(), known, [x.tobytes() for x in sums], others]

    return map_texts(keyed, ddl("doc_id bigint, digest bigint, n bigint, known bigint, sums binary, others array<struct<word: bigint, times: bigint>>"), compute, most=SLICE_BYTES)


def with_others(summed: DataFrame, vectors: DataFrame) -> DataFrame:
    """summed with added (bytes) and found: the sum of the vectors, and number, of words whose vector comes by shuffle."""
    rows = summed.select("doc_id", "digest", F.explode("others").alias("o")).select("doc_id", "digest", "o.word", "o.times").dropDuplicates(["doc_id", "digest", "word"])
    hit = rows.join(vectors, "word").repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "word")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, total, found = None, None, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([total.tobytes()]), pa.array([found], pa.int64())], names=["own_id", "own_digest", "added", "found"])

        for batch in batches:
            for doc, digest, times, vector in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "times", "vector"))):
                if (doc, digest) != last:
                    if last:
                        yield row()
                    last, total, found = (doc, digest), np.zeros(DIM), 0
                total += times * np.frombuffer(vector, np.float16).astype(np.float32)
                found += times
        if last:
            yield row()

    added = hit.mapInArrow(run, ddl("own_id bigint, own_digest bigint, added binary, found bigint"))
    return summed.drop("others").join(added, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left").drop("own_id", "own_digest")


def pooled(docs: DataFrame, least: int = LEAST, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id and vector (INPUTS floats) of each row of docs."""
    spark = docs.sparkSession
    vectors = staged(word_vectors(word_contexts(docs)).filter(F.col("n") >= least), "vectors")
    complete = vectors.count() <= most_sent
    sent = spark.sparkContext.broadcast(sent_table(most_common(vectors, most_sent).select("word", "vector")))
    if complete:
        summed = summed_documents(docs, sent, True).drop("others").withColumns({"added": F.lit(None).cast("binary"), "found": F.lit(0).cast("bigint")})
    else:
        summed = with_others(staged(summed_documents(docs, sent, False), "summed"), vectors.select("word", "vector"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.column("n").to_numpy().astype(float)
            known = batch.column("known").to_numpy() + np.nan_to_num(batch.column("found").to_numpy(zero_copy_only=False).astype(float))
            sums = np.array([np.frombuffer(x) for x in batch.column("sums").to_pylist()]).reshape(-1, DIM)
            for i, more in enumerate(batch.column("added").to_pylist()):
                if more:
                    sums[i] = sums[i] + np.frombuffer(more)
            out = np.zeros((len(n), INPUTS), np.float32)
            out[:, :DIM] = sums / np.maximum(1, known)[:, None]
            out[:, DIM] = np.linalg.norm(out[:, :DIM], axis=1)
            out[:, DIM + 1] = 1 - known / np.maximum(1, n)
            out[:, DIM + 2] = np.log1p(n)
            offsets = pa.array(np.arange(0, len(out) * INPUTS + 1, INPUTS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["doc_id", "vector"])

    return summed.mapInArrow(run, ddl("doc_id bigint, vector array<float>"))


class Network:
    """Inputs scaled to unit variance, a hidden layer of rectified units, one logit, and a temperature."""

    def __init__(self, hidden: int = 32, seed: int = 7):
        self.hidden, self.seed, self.constant = hidden, seed, None

    def logits(self, x):
        import numpy as np

        return np.maximum(0, (x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x):
        import numpy as np

        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x, y, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4):
        """Adam on four fifths of the rows, the temperature on the rest."""
        import numpy as np

        if len(y) < 10 or len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(y))
        held, rows = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-6
        shapes = [(x.shape[1], self.hidden), (self.hidden,), (self.hidden,), ()]
        weights = [rng.normal(0, (2 / x.shape[1]) ** 0.5, shapes[0]), np.zeros(shapes[1]), rng.normal(0, (1 / self.hidden) ** 0.5, shapes[2]), np.zeros(())]
        moments = [[np.zeros(s), np.zeros(s)] for s in shapes]
        scaled, step = (x - self.mean) / self.scale, 0
        for _ in range(epochs):
            rng.shuffle(rows)
            for i in range(0, len(rows), batch):
                own, want = scaled[rows[i : i + batch]], y[rows[i : i + batch]]
                w1, b1, w2, b2 = weights
                act = np.maximum(0, own @ w1 + b1)
                error = (1 / (1 + np.exp(-np.clip(act @ w2 + b2, -40, 40))) - want) / len(want)
                back = np.outer(error, w2) * (act > 0)
                grads = [own.T @ back + decay * w1, back.sum(axis=0), act.T @ error + decay * w2, error.sum()]
                step += 1
                for k, (g, (m, v)) in enumerate(zip(grads, moments)):
                    m = moments[k][0] = 0.9 * m + 0.1 * g
                    v = moments[k][1] = 0.999 * v + 0.001 * g * g
                    weights[k] = weights[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = weights
        logits, want = self.logits(x[held]), y[held]

        def loss(t):
            p = np.clip(1 / (1 + np.exp(-np.clip(logits / t, -40, 40))), 1e-6, 1 - 1e-6)
            return -(want * np.log(p) + (1 - want) * np.log(1 - p)).mean()

        self.temperature = min(np.exp(np.linspace(-1.5, 2.5, 81)).tolist(), key=loss)
        return self


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def score_quality(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, threshold: float = 0.3, least: int = LEAST, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; labels (doc_id, quality) teach only where crc32(doc_id) mod 5 isn't 0."""
    import numpy as np

    spark = docs.sparkSession
    vectors = staged(pooled(docs, least, most_sent), "pooled")
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality")).filter(fold(F.col("doc_id")) != 0)
    taught = known.join(vectors, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "vector").limit(most_labelled).select("vector", "quality").collect()
    x = np.array([r.vector for r in taught], float).reshape(len(taught), INPUTS)
    network = spark.sparkContext.broadcast(Network().fit(x, np.array([r.quality for r in taught], float)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.asarray(batch.column("vector").flatten()).reshape(-1, INPUTS).astype(float)
            score = network.value.probabilities(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = vectors.mapInArrow(run, ddl("doc_id bigint, score double, predicted int"))
    return scored.select("doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(0)) == 0).alias("held_out"), "score", "predicted")

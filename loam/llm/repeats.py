"""Passages that repeat across documents, by content-defined chunking.

A gear hash rolls over the text's UTF-8 bytes; where it falls below a bound a chunk ends, so that chunks
depend on nothing but the `WINDOW` bytes before their ends and come back into step soon after an insertion.
Two chunks that follow each other are known by a digest. Digests in two documents or more mark repeats;
marks that touch or overlap in a document join to a run, and runs of enough words and bytes are passages.

What a run loses of a passage is the part before the first and after the last chunk end in it, some thirty
bytes at either side; so passages of over fifty words leave runs well above the default least sizes.

Each digest is counted where its rows are (partial aggregates) and joined back by Spark, which may split a hot
digest; no task gathers the documents of a passage. Null and empty texts, and texts of fewer than two chunks
beyond the least sizes, have no passages; repetition inside one document alone is none; rows of one doc_id are
one document, and so are rows without an id that are equal in text; these come after all others, and their doc_id
stays null; ids are below 2 ** 62; an empty table gives no rows; input columns other than doc_id and text are ignored
or carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import ddl, keeps_columns, map_texts, staged, utf8_column, with_computed

WINDOW = 16
UNNAMED = 1 << 62
LEAST, MEAN, MOST = 8, 24, 256


def gear_table():
    """A 16-bit number for each byte, from a fixed multiplicative sequence."""
    import numpy as np

    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.uint16)


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """The ends of each text's chunks: at least LEAST bytes each but for the last, at most MOST, about LEAST + MEAN; never inside a character."""
    import numpy as np

    gap = b"\xff" * WINDOW  # keeps the hash of one text apart from the next
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    h = gear_table()[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    cut = (h * np.uint16(40503)) < 65536 // MEAN
    ends = np.flatnonzero(cut & ((np.append(data[1:], 0) & 0xC0) != 0x80)) + 1
    out, start = [], WINDOW
    inside = (data & 0xC0) == 0x80
    for text in texts:
        lo, hi = np.searchsorted(ends, [start + LEAST, start + len(text)])
        found, last = [], 0
        for end in [*(ends[lo:hi] - start).tolist(), len(text)]:
            while end - last > MOST:
                forced = last + MOST
                while inside[start + forced]:
                    forced -= 1
                found.append(forced)
                last = forced
            if end - last >= LEAST or end == len(text) and end > last:
                found.append(end)
                last = end
        out.append(found)
        start += len(text) + WINDOW
    return out


def document_key(doc_id, text):
    """doc_id, or for a row without one a number from its text that no id reaches."""
    return F.coalesce(doc_id.cast("bigint"), F.xxhash64(text).bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED)))


def marked(docs: DataFrame) -> DataFrame:
    """digest, doc_id, place and size of each pair of neighbouring chunks. place holds start and words before it, size a tag of the text, length and words."""

    def compute(parts):
        import numpy as np
        import xxhash

        from .minhash import MIX, mixed

        digest_of = xxhash.xxh3_64_intdigest
        for part in parts:
            texts = utf8_column(part, "text")
            digests, starts, ends, docs_at, tags, bases = [], [], [], [], [], []
            base = 0
            for i, (text, cuts) in enumerate(zip(texts, chunk_ends(texts))):
                if len(cuts) > 1:
                    at = [0, *cuts]
                    d = np.array([digest_of(text[a:b]) for a, b in zip(at, cuts)], np.uint64)
                    digests.append(mixed(d[:-1] * np.uint64(MIX[2]) + d[1:]))
                    starts.append(np.array(at[:-2], np.int64) + base)
                    ends.append(np.array(at[2:], np.int64) + base)
                    docs_at.append(np.full(len(d) - 1, i))
                    bases.append(np.full(len(d) - 1, base))
                    tags.append(np.full(len(d) - 1, digest_of(text) & 0x7FFFFFFF))
                base += len(text)
            if not digests:
                continue
            data = np.frombuffer(b"".join(texts), np.uint8)
            white = (data == 32) | ((data >= 9) & (data <= 13))
            first = ~white
            first[1:] &= white[:-1]
            first[np.unique(np.concatenate(bases))] = ~white[np.unique(np.concatenate(bases))]
            words = np.concatenate([[0], np.cumsum(first)])
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            a, b, base_at = np.concatenate(starts), np.concatenate(ends), np.concatenate(bases)
            place = ((chars[a] - chars[base_at]) << 32) | (words[a] - words[base_at])
            size = (np.concatenate(tags) << 32) | ((chars[b] - chars[a]) << 16) | (words[b] - words[a])
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[np.concatenate(docs_at)]
            import pyarrow as pa

            yield [pa.array(x, pa.int64()) for x in (np.concatenate(digests).view(np.int64), ids, place, size)]

    return map_texts(docs.select(document_key(F.col("doc_id"), F.col("text")).alias("doc_id"), "text"), ddl("digest bigint, doc_id bigint, place bigint, size bigint"), compute)


def repeated_passages(docs: DataFrame, least_words: int = 13, least_chars: int = 64) -> DataFrame:
    """doc_id, tag, start and end (code points), n_words, first_doc_id, kept and doc_key of each passage of each document that other documents share.

    Marks that the document is the first to have (kept) and marks that an earlier one has join to runs apart.
    first_doc_id is the least doc_id that shares a part of the run.
    """
    marks = staged(marked(docs), "marks")
    shared = marks.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("first_doc < last_doc").drop("last_doc")
    hits = marks.join(shared, "digest").select(
        "doc_id",
        F.expr("cast(shiftright(size, 32) as int)").alias("tag"),
        F.expr("cast(shiftright(place, 32) as int)").alias("start"),
        F.expr("cast(shiftright(place, 32) + (shiftright(size, 16) & 65535) as int)").alias("end"),
        F.expr("cast(place & 4294967295 as int)").alias("word"),
        F.expr("cast((place & 4294967295) + (size & 65535) as int)").alias("last_word"),
        "first_doc",
    )
    hits = hits.withColumn("kept", F.col("first_doc") == F.col("doc_id"))
    order = Window.partitionBy("doc_id", "tag", "kept").orderBy("start", "end")
    opens = F.col("start") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = hits.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    passages = runs.groupBy("doc_id", "tag", "kept", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last_word") - F.min("word")).cast("bigint").alias("n_words"), F.min("first_doc").alias("first_doc_id"))
    long = passages.filter((F.col("n_words") >= least_words) & (F.col("end") - F.col("start") >= least_chars))
    named = lambda c: F.when(F.col(c) < UNNAMED, F.col(c)).alias(c)
    return long.select(named("doc_id"), "tag", "start", "end", "n_words", named("first_doc_id"), "kept", F.col("doc_id").alias("doc_key"))


@keeps_columns
def remove_repeats(docs: DataFrame, least_words: int = 13, least_chars: int = 64) -> DataFrame:
    """docs without the passages that a document of lower doc_id has; the columns stay as they are."""
    spans = repeated_passages(docs, least_words, least_chars).filter("not kept").groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("repeated_spans"))

    def compute(part):
        import xxhash

        out = []
        for text, found in zip(part.column("text").to_pylist(), part.column("repeated_spans").to_pylist()):
            if text and found:
                tag = xxhash.xxh3_64_intdigest(text.encode()) & 0x7FFFFFFF
                for span in reversed([s for s in found if s["tag"] == tag]):
                    text = text[: span["start"]] + text[span["end"] :]
            out.append(text)
        return [out]

    joined = docs.withColumn("doc_key", document_key(F.col("doc_id"), F.col("text"))).join(staged(spans, "spans"), "doc_key", "left")
    done = with_computed(joined, ddl("remaining_text string"), compute).withColumn("text", F.col("remaining_text"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)

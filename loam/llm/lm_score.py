"""Language-model scores of documents: context-tree weighting (see ctw), beside a smoothed word-count base.

Documents whose crc32(doc_id as text) mod 5 is 1 are held out: they are scored, not learnt from.

What every byte gram costs and how often the corpus has every word are tables that grow without bound. The most
frequent grams and words, at most `most_grams` and `most_words`, are broadcast; the rest come by shuffle to blocks
of documents of bounded bytes, which ask for those that they have. Which way one comes changes no score, and the
tree has one depth at every size.

The tree: its lower levels, from `depth` up to LOW bytes of context, grow where the grams of equal last LOW
context bytes meet (at most 256 ** (depth - LOW + 1) of them: 2 ** 24 at depth 5). The levels above are sums over
those below, made by Spark level by level, and joined back to the contexts that hang from them.

Null and empty texts are the end token alone; rows are scored each by itself; a null doc_id is never held out;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bound_batches, ddl, map_texts, slices, staged, utf8_column
from .ctw import GramCosts, block_log, combined, cost, decision, grow, spread, tally

FOLDS, HELD_OUT = 5, 1
END_TOKEN = ""
LOW = 3
SLICE_BYTES = 2 << 20  # of text at a time: the longer, the fewer different grams a byte


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def blocked_documents(spark: SparkSession, path: str, rows: int = 4096, usual_bytes: int = 4096) -> DataFrame:
    """The documents of Parquet files with a column block, the same wherever they are read: `rows` neighbours in a file, but texts of 2 ** k times the usual bytes are dealt to 2 ** k blocks, so that none holds over 2 * rows * usual_bytes, or one longer text."""
    docs = spark.read.parquet(path)
    at, size = F.col("_metadata.row_index"), F.coalesce(F.octet_length("text"), F.lit(0))
    times = F.least(F.lit(rows), F.greatest(F.lit(1), F.pow(F.lit(2), F.floor(F.log2(size / usual_bytes))))).cast("long")
    return docs.select("doc_id", "text", F.xxhash64(F.col("_metadata.file_path"), (at / rows).cast("long"), F.coalesce(times, F.lit(1)), F.pmod(at, F.coalesce(times, F.lit(1)))).alias("block"))


def dealt_documents(docs: DataFrame, block_bytes: int) -> DataFrame:
    """docs with a column block, written once: neighbouring rows of about block_bytes of text, or one longer text, share a block."""
    bound_batches(docs.sparkSession)

    def deal(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, block))], names=[*part.schema.names, "block"])
                size += 64 * part.num_rows + (pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
                if size >= block_bytes:
                    block, size = block + 1, 0

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return staged(base.mapInArrow(deal, ddl("doc_id bigint, text string, block bigint")), "blocked")


def gram_counts(docs: DataFrame, depth: int, most: int = 2_000_000) -> DataFrame:
    """gram and n, how often the training texts have it, of every gram of every text. Tasks add up before Spark does."""

    def compute(parts):
        import numpy as np
        import pyarrow as pa

        held, size = [], 0
        for part in parts:
            grams, counts = spread([t.lower() for t in utf8_column(part, "text")], depth)
            weights = np.repeat(part.column("train").to_numpy(zero_copy_only=False).astype(float), counts)
            coded = pa.array(grams).dictionary_encode()
            held.append((coded.dictionary.to_numpy(zero_copy_only=False), np.bincount(coded.indices.to_numpy(zero_copy_only=False), weights, len(coded.dictionary))))
            size += len(held[-1][0])
            if size > most:
                held = [tally(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > most // 2:
                    yield [pa.array(held[0][0].view(np.int64)), pa.array(held[0][1].astype(np.int64))]
                    held, size = [], 0
        if held:
            keys, n = tally(*(np.concatenate(x) for x in zip(*held)))
            yield [pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))]

    partial = map_texts(docs.select("text", "train"), ddl("gram bigint, n bigint"), compute, most=SLICE_BYTES)
    return partial.groupBy("gram").agg(F.sum("n").alias("n"))


def words_of(texts):
    """(words, document of each, lower-cased texts) of an Arrow array of texts, without the end tokens."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    low = pc.ascii_lower(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(low)
    words, doc = lists.flatten(), np.repeat(np.arange(len(low)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), doc[some.to_numpy(zero_copy_only=False)], low.cast(pa.large_binary() if pa.types.is_large_string(low.type) else pa.binary())


def word_counts(docs: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """word and n, how often the training texts have it, of every word of every text and of the end token. Tasks add up before Spark does."""

    def compute(parts):
        import numpy as np
        import pyarrow as pa

        def summed(held):
            coded = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
            return coded.dictionary, np.bincount(coded.indices.to_numpy(zero_copy_only=False), np.concatenate([n for _, n in held]), len(coded.dictionary))

        held, size = [], 0
        for part in parts:
            train = part.column("train").to_numpy(zero_copy_only=False).astype(float)
            words, doc, _ = words_of(part.column("text"))
            held.append(summed([(words, train[doc]), (pa.array([END_TOKEN], words.type), np.array([train.sum()]))]))
            size += held[-1][0].nbytes + held[-1][1].nbytes
            if size > most_bytes:
                held = [summed(held)]
                size = held[0][0].nbytes + held[0][1].nbytes
                if size > most_bytes // 2:
                    yield [held[0][0].cast(pa.string()), pa.array(held[0][1].astype(np.int64))]
                    held, size = [], 0
        if held:
            words, n = summed(held)
            yield [words.cast(pa.string()), pa.array(n.astype(np.int64))]

    return map_texts(docs.select("text", "train"), ddl("word string, n bigint"), compute).groupBy("word").agg(F.sum("n").alias("n"))


def most_common(table: DataFrame, most: int) -> DataFrame:
    """The rows of largest n, at most `most`: all those from a bound upwards. The bound comes from eight counts for each doubling of n."""
    rank = F.floor(8 * F.log2("n"))
    bound, rows = None, 0
    for r in sorted(table.filter("n > 0").groupBy(rank.alias("rank")).count().collect(), key=lambda r: -r["rank"]):
        rows += r["count"]
        if rows > most:
            break
        bound = r["rank"]
    return table.filter(F.lit(False) if bound is None else (F.col("n") > 0) & (rank >= bound))


def gram_costs(counts: DataFrame, depth: int, grams_each: int = 400_000) -> DataFrame:
    """gram, n and bits: what each gram of counts (gram, n: how often training has it) costs in the tree of those with n > 0."""
    import numpy as np

    low = min(LOW, depth)
    parts = max(1, -(-counts.count() // grams_each))
    context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * low)) - 1))
    dealt = counts.withColumn("part", F.pmod(F.xxhash64(context), F.lit(parts)))

    def lower(table):
        grams, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
        return grams, *grow(grams[n > 0], n[n > 0], depth, low)

    def asked(grams):
        mask = np.uint64((1 << (8 * (low + 1))) - 1)
        return np.unique(np.concatenate([np.unique(decision(grams & mask, k)) for k in range(8)]))

    def contexts(table):
        import pyarrow as pa

        grams, _, (keys, n0, n1, weighted) = lower(table)
        rest = np.setdiff1d(asked(grams), keys)
        zeros = np.zeros(len(rest))
        columns = (np.concatenate(x) for x in ((keys.view(np.int64), rest.view(np.int64)), (n0, zeros), (n1, zeros), (weighted, zeros)))
        return pa.table([pa.array(table.column("part")[0].as_py() + 0 * np.arange(len(keys) + len(rest))), *map(pa.array, columns)], names=["part", "key", "n0", "n1", "weighted"])

    lowest = staged(dealt.groupBy("part").applyInArrow(contexts, ddl("part bigint, key bigint, n0 double, n1 double, weighted double")), "contexts")

    def level(batches):
        import pyarrow as pa

        for batch in batches:
            n0, n1, below = (batch.column(c).to_numpy() for c in ("n0", "n1", "below"))
            share, weighted = combined(block_log(n0, n1), below)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, (n0, n1, weighted, share, (n1 + 0.5) / (n0 + n1 + 1)))], names=["key", "n0", "n1", "weighted", "share", "one"])

    above, below = lowest.select("part", "key"), lowest.filter("n0 + n1 > 0")
    added, kept, alone = F.lit(0.0), F.lit(1.0), F.lit(None).cast("double")
    for d in range(low - 1, -1, -1):
        key = F.col("key").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1))
        sums = below.groupBy(key.alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        below = staged(sums.mapInArrow(level, ddl("key bigint, n0 double, n1 double, weighted double, share double, one double")), f"level{d}")
        own = below.select(F.col("key").alias(f"key{d}"), F.col("share").alias(f"share{d}"), F.col("one").alias(f"one{d}"))
        # Depth 1 has at most 256 * 255 nodes, depth 0 has 255.
        above = above.join(F.broadcast(own) if d < 2 else own, key == F.col(f"key{d}"), "left")
        share, one = F.col(f"share{d}"), F.col(f"one{d}")
        added, kept = share * one + (1 - share) * added, (1 - share) * kept
        alone = F.when(one.isNull(), alone).when(alone.isNull(), one).otherwise(share * one + (1 - share) * alone)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    above = above.select("part", "key", zero(added).alias("added"), zero(kept).alias("kept"), F.coalesce(alone, F.lit(0.5)).alias("alone"))

    def costs(left, right):
        import pyarrow as pa

        grams, levels, _ = lower(left)
        keys = right.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        bits = cost(levels, grams, (keys[order], *(right.column(c).to_numpy()[order] for c in ("added", "kept", "alone"))))
        return pa.table({"gram": left.column("gram"), "n": left.column("n"), "bits": pa.array(bits.astype(np.float32))})

    return dealt.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(costs, ddl("gram bigint, n bigint, bits float"))


def asked_for(docs: DataFrame, depth: int, tree, vocabulary) -> DataFrame:
    """block, gram and word (one of them null): the grams and words of each block that are not among the broadcast ones."""

    def compute(parts):
        import numpy as np
        import pyarrow as pa

        shared = set(vocabulary.value[0].to_pylist())
        for part in parts:
            block = part.column("block").to_numpy(zero_copy_only=False)
            words, doc, low = words_of(part.column("text"))
            coded = words.dictionary_encode()
            rare = np.fromiter((w not in shared for w in coded.dictionary.to_pylist()), bool, len(coded.dictionary))
            rare = rare[coded.indices.to_numpy(zero_copy_only=False)]
            words, doc = words.filter(pa.array(rare)), doc[rare]
            grams, counts = spread(low.to_pylist(), depth)
            coded = pa.array(grams).dictionary_encode()
            rare = tree.value.places(coded.dictionary.to_numpy(zero_copy_only=False))[1]
            rare = rare[coded.indices.to_numpy(zero_copy_only=False)]
            at = np.concatenate([np.repeat(block, counts)[rare], block[doc]])
            grams = grams[rare].view(np.int64)
            found = pa.table([pa.array(at), pa.concat_arrays([pa.array(grams), pa.nulls(len(words), pa.int64())]), pa.concat_arrays([pa.nulls(len(grams), words.type), words])], names=["block", "gram", "word"])
            found = found.group_by(["block", "gram", "word"]).aggregate([]).combine_chunks()
            yield [found.column("block").combine_chunks(), found.column("gram").combine_chunks(), found.column("word").combine_chunks().cast(pa.string())]

    return map_texts(docs.select("block", "text"), ddl("block bigint, gram bigint, word string"), compute, most=SLICE_BYTES).distinct()


def score_documents(docs: DataFrame, depth: int = 5, block: str | None = None, block_bytes: int = 16 << 20, most_grams: int = 4_000_000, most_words: int = 400_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row of docs.

    block: a column that is equal for rows of bounded bytes only and the same whenever docs is read; without one,
    docs is written with blocks of about block_bytes. At most most_grams costs (12 bytes each) and most_words
    counts (words of 64 bytes at most) are broadcast.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6: a gram is kept in 64 bits")
    source = docs.select("doc_id", "text", F.col(block).cast("bigint").alias("block")) if block else dealt_documents(docs, block_bytes)
    dealt = source.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "block", (~held_out(F.col("doc_id"))).alias("train"))
    context = docs.sparkSession.sparkContext
    costs = staged(gram_costs(staged(gram_counts(dealt, depth), "counts"), depth), "costs")
    counted = staged(word_counts(dealt), "words")
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("n") > 0).alias("distinct"), F.coalesce(F.max(F.when(F.col("word") == END_TOKEN, F.col("n"))), F.lit(0)).alias("ends")).collect()[0]
    total, ends, scale = sums["tokens"], sums["ends"], math.log10(sums["tokens"] + 0.5 * (sums["distinct"] + 1))
    common = most_common(costs, most_grams).select("gram", "bits").toArrow()
    tree = context.broadcast(GramCosts(common["gram"].to_numpy().view("uint64"), common["bits"].to_numpy(), depth))
    common = most_common(counted.filter(F.octet_length("word") <= 64), most_words).select("word", "n").toArrow().combine_chunks()
    vocabulary = context.broadcast((common["word"].combine_chunks(), common["n"].to_numpy().astype(float)))
    del common
    asked = staged(asked_for(dealt, depth, tree, vocabulary), "asked")
    no_word, no_gram = F.lit(None).cast("string").alias("word"), F.lit(None).cast("bigint").alias("gram")
    cold_grams = asked.filter("gram is not null").select("block", "gram").join(costs, "gram").select("block", "gram", no_word, F.col("bits").cast("double").alias("x"))
    cold_words = asked.filter("gram is null").select("block", "word").join(counted, "word").select("block", no_gram, "word", F.col("n").cast("double"))

    def score(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        of_words = pc.is_valid(right.column("word"))
        words_asked, grams_asked = right.filter(of_words), right.filter(pc.invert(of_words))
        rest = GramCosts(grams_asked.column("gram").to_numpy().view(np.uint64), grams_asked.column("x").to_numpy(), depth)
        words, doc, low = words_of(left.column("text").combine_chunks())
        known = [vocabulary.value, (words_asked.column("word").combine_chunks(), words_asked.column("x").to_numpy())]
        names, numbers = pa.concat_arrays([w.cast(words.type) for w, _ in known]), np.concatenate([n for _, n in known])
        c = numbers[pc.index_in(words, value_set=names).to_numpy(zero_copy_only=False)]
        n_tokens = np.bincount(doc, minlength=len(low)) + 1
        n_known = np.bincount(doc, c > 0, len(low)).astype(np.int64) + int(ends > 0)
        base = np.bincount(doc, np.log10(c + 0.5), len(low)) + math.log10(ends + 0.5) - n_tokens * scale
        batch = pa.RecordBatch.from_arrays([low], names=["text"])
        bits = np.concatenate([tree.value.text_bits(part.column("text").to_pylist(), rest) for part in slices(batch, "text", SLICE_BYTES)])
        sizes = pc.binary_length(low).to_numpy(zero_copy_only=False) + 1
        columns = [left.column("doc_id"), pa.array(n_tokens.astype(np.int64)), pa.array(n_known), pa.array(base), pa.array(-bits * math.log10(2)), pa.array(bits / sizes)]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    schema = ddl("doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, bits_per_byte double")
    scored = dealt.select("block", "doc_id", "text").groupBy("block").cogroup(cold_grams.union(cold_words).groupBy("block")).applyInArrow(score, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score", "bits_per_byte")

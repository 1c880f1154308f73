"""Near-duplicate documents by DartMinHash over weighted word shingles, banded joining and exact checks.

A shingle is `width` consecutive words; its weight is how often the document has it, and similarity is
weighted Jaccard. Each unit of a shingle's weight is a region at which darts are thrown: a Poisson process of
ranks drawn from hashes, the same in every document. A document throws the darts of rank up to a bound that
fits its own weight, each dart belongs to one of k coordinates by hash, and the earliest dart of each
coordinate is its signature: two signatures agree in a coordinate with a chance equal to the similarity.

Equal texts are first brought together by digest. Documents whose signatures agree on a band meet in a
bucket. Pairs in a bucket are not multiplied out: each member is compared with the bucket's first; where a
bucket then holds several classes, its members are compared with others in orders drawn anew, which links most
of them cheaply. What buckets still hold several classes then goes through an exact prefix filter: of two
members of different classes that share a band, only those whose sizes and rarest shingles rule a similarity of
the threshold out are not compared. Accepted pairs form the classes. Pairs are accepted on exact shingle counts,
so a class never rests on an estimate.

Texts of fewer words than a shingle are one shingle; null, empty and wordless texts are alone in their
classes, unless equal in text (nulls with nulls); equal rows share a class; an empty table gives no rows. A null
doc_id comes after all others: class_id is null only where no document of the class has an id, and such a class is
represented by its first text's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import ddl, keeps_columns, map_texts, staged, utf8_column, with_computed
from .decontaminate import words_of
from .graph import components, joined_components

MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def mixed(x):
    """splitmix64's finaliser over an array of unsigned 64-bit integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[bytes], width: int):
    """(document, shingle hash) arrays: every shingle occurrence of every text, in order."""
    import numpy as np
    import xxhash

    words, counts, known = [], [], {}
    for text in texts:
        own = words_of(text)
        counts.append(len(own))
        words += own
    for w in set(words):
        known[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    counts = np.array(counts, np.int64)
    starts = np.cumsum(counts) - counts
    # Runs of `width` words inside one text; a shorter text is one run of all its words.
    hashes = np.zeros(len(ids), np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(ids)) - starts[doc]
    length = np.minimum(width, counts)
    for i in range(width):
        at = np.minimum(np.arange(len(ids)) + i, max(0, len(ids) - 1))
        with_word = i < length[doc]
        hashes = np.where(with_word, mixed(hashes * np.uint64(MIX[2]) + ids[at] + np.uint64(i + 1)), hashes)
    first = place <= counts[doc] - length[doc]
    return doc[first], hashes[first]


def weighted(doc, hashes):
    """Distinct (document, hash) with their counts, in order of both."""
    import numpy as np

    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def dart_signatures(doc, hashes, weights, n_docs: int, k: int):
    """(n_docs, k) signatures of unsigned integers. Documents without shingles get zeros."""
    import numpy as np

    out = np.zeros((n_docs, k), np.uint64)
    # A unit of weight is a region: the u-th occurrence of a shingle.
    owner = np.repeat(doc, weights)
    unit = np.arange(len(owner)) - np.repeat(np.cumsum(weights) - weights, weights)
    region = mixed(np.repeat(hashes, weights) + mixed(unit.astype(np.uint64) + np.uint64(1)))
    mass = np.bincount(owner, minlength=n_docs).astype(float)
    todo, darts = mass > 0, k * np.log(k) + 2.0 * k
    while todo.any():
        bound = np.where(todo, darts / np.maximum(mass, 1), 0.0)
        rows = np.flatnonzero(todo[owner])
        seed, own, rank = region[rows], owner[rows], np.zeros(len(rows))
        found = []
        while len(own):
            seed = mixed(seed + np.uint64(MIX[2]))
            rank = rank - np.log(((seed >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            inside = rank <= bound[own]
            seed, own, rank = seed[inside], own[inside], rank[inside]
            found.append((own, rank, seed))
        own, rank, seed = (np.concatenate(x) for x in zip(*found))
        cell = own * k + (mixed(seed ^ np.uint64(MIX[0])) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((seed, rank, cell))
        cell = cell[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        filled = np.bincount(cell[first] // k, minlength=n_docs) == k
        ready = todo & filled
        use = ready[cell[first] // k]
        out.reshape(-1)[cell[first][use]] = seed[order][first][use]
        todo &= ~filled
        darts *= 2  # a coordinate stayed empty: throw more
    return out


def band_keys(signatures, bands: int):
    """(n, bands) of signed integers: a hash of each band's coordinates."""
    import numpy as np

    n, k = signatures.shape
    rows = k // bands
    keys = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = mixed(keys * np.uint64(MIX[2]) + signatures[:, r::rows][:, :bands])
    return keys.view(np.int64)


def signed_texts(docs: DataFrame, width: int, k: int, bands: int) -> DataFrame:
    """doc_id, node (128 bits of the text's SHA-256, as hex) and the keys of its bands; no bands without words."""

    def compute(parts):
        import hashlib

        import numpy as np

        for part in parts:
            texts = utf8_column(part, "text")
            doc, hashes, weights = weighted(*shingle_hashes(texts, width))
            keys = band_keys(dart_signatures(doc, hashes, weights, len(texts), k), bands).tolist()
            worded = set(np.unique(doc).tolist())
            null = part.column("text").is_null().to_pylist()
            nodes = ["null" if n else hashlib.sha256(t).hexdigest()[:32] for t, n in zip(texts, null)]
            yield [part.column("doc_id"), nodes, [key if i in worded else [] for i, key in enumerate(keys)]]

    return map_texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ddl("doc_id bigint, node string, bands array<bigint>"), compute)


def node_of(text):
    return F.coalesce(F.substring(F.sha2(text, 256), 1, 32), F.lit("null"))


def weighted_jaccard(pairs: DataFrame, width: int) -> DataFrame:
    """a, b and similarity of pairs with text_a and text_b, from their shingle counts."""

    def compute(part):
        import numpy as np

        n = part.num_rows
        doc, hashes, counts = weighted(*shingle_hashes(utf8_column(part, "text_a") + utf8_column(part, "text_b"), width))
        mass = np.bincount(doc, counts, 2 * n)
        pair = doc % n
        order = np.lexsort((hashes, pair))
        pair, hashes, counts = pair[order], hashes[order], counts[order]
        same = np.flatnonzero((pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1])) + 1
        shared = np.bincount(pair[same], np.minimum(counts[same], counts[same - 1]), n)
        return [(shared / np.maximum(1, mass[:n] + mass[n:] - shared)).tolist()]

    return with_computed(pairs, ddl("similarity double"), compute, text="text_a").select("a", "b", "similarity")


def star_pairs(members: DataFrame) -> DataFrame:
    """a < b: each member of a bucket with the bucket's least member."""
    first = members.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return members.join(first, "band").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()


def other_pairs(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """a < b: in buckets of three or more that hold several classes, each member outside the bucket's largest class with one of that class and with the one before it.

    Whom they meet is drawn anew for each bucket and turn. Large buckets are split into parts of about a
    thousand for the order alone.
    """
    classed = members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    place = F.xxhash64("node", "band", F.lit(turn))
    classes = classed.groupBy("band", "label").agg(F.count("*").alias("n"), F.min(F.struct(place.alias("place"), "node")).alias("drawn"))
    buckets = classes.groupBy("band").agg(F.sum("n").alias("n"), F.count("*").alias("classes"), F.max(F.struct("n", "label", "drawn")).alias("main")).filter("n > 2 and classes > 1")
    outside = classed.join(buckets, "band").filter(F.col("label") != F.col("main.label")).withColumn("place", place)
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / 1000))
    order = Window.partitionBy("band", part).orderBy("place", "node")
    linked = outside.withColumn("before", F.lag(F.struct("node", "label")).over(order))
    pair = lambda other: F.struct(F.least("node", other).alias("a"), F.greatest("node", other).alias("b"))
    met = F.array(pair(F.col("main.drawn.node")), F.when(F.col("before.label") != F.col("label"), pair(F.col("before.node"))))
    return linked.select(F.explode(F.array_compact(met)).alias("p")).select("p.a", "p.b").distinct()


def mixed_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label and bands (those shared with another class) of members of buckets of three or more that hold several classes."""
    classed = members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    mixed_bands = classed.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).filter("n > 2 and least <> most").select("band")
    return classed.join(mixed_bands, "band").groupBy("node", "label").agg(F.collect_set("band").alias("bands"))


def shingle_units(texts: DataFrame, width: int) -> DataFrame:
    """node, mass (number of shingles) and unit, a hash for each occurrence of each shingle: the u-th of a shingle is the same unit in every text."""

    def compute(parts):
        import numpy as np
        import pyarrow as pa

        for part in parts:
            doc, hashes, weights = weighted(*shingle_hashes(utf8_column(part, "text"), width))
            owner = np.repeat(doc, weights)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(weights) - weights, weights)
            units = mixed(np.repeat(hashes, weights) + mixed(nth.astype(np.uint64) + np.uint64(1)))
            mass = np.bincount(owner, minlength=part.num_rows)
            yield [part.column("node").take(pa.array(owner)), pa.array(mass[owner]), pa.array(units.view(np.int64))]

    return map_texts(texts, ddl("node string, mass bigint, unit bigint"), compute)


def possible_pairs(mixed_nodes: DataFrame, lookup: DataFrame, width: int, threshold: float) -> DataFrame:
    """a < b: every pair of different classes with a band in common that may reach the threshold.

    Units are put in one order, rarest first. Two texts of similarity t or more have at least
    t / (1 + t) of their sizes' sum in common, so the first unit that they share comes early in both: no later
    than leaves that many units after it. Pairs meet at such units alone; a unit that one text has meets none.
    """
    units = staged(shingle_units(lookup.join(mixed_nodes.select("node"), "node"), width), "units")
    shared = units.groupBy("unit").agg(F.count("*").alias("n")).filter("n > 1")
    of_node = Window.partitionBy("node")
    at = F.col("mass") - F.count("*").over(of_node) + F.row_number().over(of_node.orderBy("n", "unit")) - 1  # own units come first
    early = units.join(shared, "unit").withColumn("at", at).filter(F.col("mass") - F.col("at") >= F.lit(threshold) * F.col("mass") - 1e-6)
    early = staged(early.select("node", "mass", "unit", "at").join(mixed_nodes, "node"), "early")
    side = lambda x: early.select("unit", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "mass", "at", "label", "bands")])
    most = 2 * threshold / (1 + threshold)
    # The smaller of the two has a partner of its own size at least, so its units must come earlier still.
    small = side("a").filter(F.col("mass_a") - F.col("at_a") >= F.lit(most) * F.col("mass_a") - 1e-6)
    least = F.lit(threshold / (1 + threshold)) * (F.col("mass_a") + F.col("mass_b")) - 1e-6
    met = (
        (small.unit == F.col("other"))
        & (F.struct("mass_a", "node_a") < F.struct("mass_b", "node_b"))
        & (F.col("label_a") != F.col("label_b"))
        & (F.least(F.col("mass_a") - F.col("at_a"), F.col("mass_b") - F.col("at_b")) >= least)
        & F.arrays_overlap("bands_a", "bands_b")
    )
    pairs = small.join(side("b").withColumnRenamed("unit", "other"), met)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, k: int = 80, bands: int = 20, turns: int = 4, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, node (its text's digest), class_id (least doc_id of the class) and representative, a row for each row of docs.

    k / bands coordinates a band: at 80 and 20 a pair of similarity 0.8 misses every band with a chance of
    2e-5. After the first comparisons, buckets that hold several classes are compared in up to `turns` further
    orders, as long as that joins classes; then every pair that shares a band, is of two classes and may reach the
    threshold is compared, so that no pair that meets is left out.
    """
    signed = staged(signed_texts(docs, width, k, bands), "signed")
    texts = signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    rows = texts.select("node", "rep", F.explode("bands").alias("band"))
    crowded = rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    members = staged(rows.join(crowded, "band"), "members")
    # A row is found by its id, one without an id by its text.
    needed = members.select("node", F.coalesce(F.col("rep").cast("string"), "node").alias("at")).distinct()
    small = needed.count() <= broadcast_rows
    source = docs.select(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), node_of(F.col("text"))).alias("at"), "text")
    found = source.join(F.broadcast(needed) if small else needed, "at").filter(node_of(F.col("text")) == F.col("node"))
    lookup = staged(found.select("node", "text").dropDuplicates(["node"]), "texts")

    def compared(pairs):
        a, b = (lookup.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        return weighted_jaccard(pairs.join(a, "a").join(b, "b"), width)

    edges = staged(compared(star_pairs(members)), "compared")
    labels = components(edges.filter(F.col("similarity") >= threshold).select("a", "b"))
    for turn in range(turns):
        fresh = other_pairs(members, labels, turn).join(edges.select("a", "b"), ["a", "b"], "left_anti")
        more = staged(compared(fresh), "compared")
        new = more.filter(F.col("similarity") >= threshold).select("a", "b")
        edges = edges.union(more)
        if not new.limit(1).count():
            break
        labels = joined_components(labels, new)
    mixed_nodes = staged(mixed_members(members, labels), "mixed")
    rest = possible_pairs(mixed_nodes, lookup, width, threshold).join(edges.select("a", "b"), ["a", "b"], "left_anti")
    new = staged(compared(rest).filter(F.col("similarity") >= threshold).select("a", "b"), "compared")
    if new.limit(1).count():
        labels = joined_components(labels, new)
    classes = texts.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = classes.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "node")).alias("low"))
    of_node = classes.join(lowest, "label").select("node", F.col("low.rep").alias("class_id"), (F.col("low.node") == F.col("node")).alias("first_text"))
    judged = signed.select("doc_id", "node").join(of_node, "node")
    return judged.select("doc_id", "node", "class_id", (F.col("first_text") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("representative"))


@keeps_columns
def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class, the one of least doc_id; of rows equal in doc_id and text one stays; the columns stay as they are."""
    kept = staged(near_duplicates(docs, **options).filter("representative").select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node")).distinct(), "kept")
    again = docs.withColumn("kept_node", node_of(F.col("text")))
    out = again.join(kept, again.doc_id.eqNullSafe(kept.kept_id) & (again.kept_node == kept.kept_node), "left_semi")
    return out.dropDuplicates(["doc_id", "kept_node"]).select(*docs.columns)

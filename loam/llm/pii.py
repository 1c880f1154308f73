"""Personal data: fixed patterns find protected entities; corpus co-occurrence then finds terms that give an entity away.

A term near an entity discloses it when their pointwise mutual information, as a share of the entity's own
information content, reaches a threshold: knowing the term, one could as well have read the entity.
Co-occurrences are counted over different contexts (the `width` words on either side of an entity, however far), so that copies of a document
count once; how common a term is, is counted over all documents. A term that discloses an entity is marked wherever
it stands in a document that holds the entity.

Null and empty texts hold nothing; repeated rows get the same spans each; a null doc_id changes nothing; ties between spans are ordered by
start, then kind; an empty table gives no rows; input columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from .common import ddl, keeps_columns, map_texts, staged, text_column, with_computed

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlap. Each @ is tried once, so that long runs of letters cost no more than their length."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            found.append((start, host.end()))
        free = host.end() if host else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) in code points, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """The lower-cased words of a text that touch none of its spans, with their places, in order."""
    found, covered = [], covering(spans)
    i = 0
    for m in TERM.finditer(text):
        while i < len(covered) and covered[i][1] <= m.start():
            i += 1
        if i == len(covered) or m.end() <= covered[i][0]:
            found.append((m[0].lower(), m.start(), m.end()))
    return found


def covering(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """The runs of places that spans (start, kind, end; by start) cover."""
    runs: list[list[int]] = []
    for a, _, b in spans:
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def context(words: list[tuple[str, int, int]], ends: list[int], starts: list[int], start: int, end: int, width: int) -> list[tuple[str, int, int]]:
    """The width words before and after a span, of a text's words with their ends and starts."""
    upto, since = bisect_right(ends, start), bisect_left(starts, end)
    return words[max(0, upto - width) : upto] + words[since : since + width]


def entity_name(kind: int, text: str) -> str:
    return f"{KINDS[kind]}:{text.lower() if kind == 0 else re.sub('[^0-9.]' if kind == 1 else '[^0-9]', '', text)}"


FOUND = (
    "spans array<struct<start: int, kind: int, end: int>>, "
    "near array<struct<entity: string, window: bigint, term: string, start: int, end: int>>"
)


def find_base(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id with its base spans, a digest of its text (null without entities), and the context words of each entity."""

    def compute(part):
        import xxhash

        spans, near = [], []
        for text in text_column(part, "text"):
            own = base_spans(text)
            spans.append([{"start": a, "kind": k, "end": b} for a, k, b in own])
            rows = []
            said = words_outside(text, own) if own else []
            starts, ends = [w[1] for w in said], [w[2] for w in said]
            for a, k, b in own:
                words = context(said, ends, starts, a, b, width)
                window = xxhash.xxh3_64_intdigest(" ".join(w for w, _, _ in words).encode()) - (1 << 63)
                entity = entity_name(k, text[a:b])
                rows += [{"entity": entity, "window": window, "term": w, "start": x, "end": y} for w, x, y in words]
            near.append(rows)
        return [spans, near]

    done = with_computed(docs.select("doc_id", "text"), ddl(FOUND), compute)
    return done.withColumn("row_digest", F.when(F.size("spans") > 0, F.md5("text"))).drop("text")


def document_frequency(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """term, df: in how many documents each term is. Tasks add up at most `most` terms before they hand them on."""

    def compute(parts):
        counts: Counter = Counter()
        for part in parts:
            for text in text_column(part, "text"):
                counts.update(set(TERM.findall(text.lower())))
                if len(counts) > most:
                    yield [list(counts), list(counts.values())]
                    counts = Counter()
        yield [list(counts), list(counts.values())]

    return map_texts(docs.select("text"), ddl("term string, n bigint"), compute).groupBy("term").agg(F.sum("n").alias("df"))


def disclosing_terms(docs: DataFrame, found: DataFrame, threshold: float = 0.5, support: int = 3) -> DataFrame:
    """entity, term and disclosure (0 to 1) of terms that reach the threshold, each seen in at least `support` different contexts of the entity."""
    seen = found.select(F.explode("near").alias("x")).select("x.entity", "x.window", "x.term").distinct()
    pairs = seen.groupBy("entity", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= support)
    entities = seen.groupBy("entity").agg(F.count_distinct("window").alias("contexts"))
    rows = docs.agg(F.count("*").alias("documents"))
    known = pairs.join(entities, "entity").join(document_frequency(docs), "term").crossJoin(F.broadcast(rows))
    total = F.greatest(F.col("documents"), F.col("contexts")).cast("double")
    often = F.greatest(F.col("df"), F.col("both"))
    shared = F.log(F.col("both") * total / (F.col("contexts") * often))
    own = F.log(total / F.col("contexts"))
    share = F.when(own > 0, shared / own).otherwise(F.lit(0.0))
    return known.withColumn("disclosure", share).filter(F.col("disclosure") >= threshold).select("entity", "term", "disclosure")


def disclosed_places(docs: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """row_digest and terms: the places of disclosing terms in each different text that holds one of their entities."""
    held = found.select("row_digest", F.explode("near").alias("x")).select("row_digest", "x.entity").distinct()
    words = staged(held.join(terms, "entity").groupBy("row_digest").agg(F.collect_set("term").alias("words")), "words")
    texts = docs.select("text", F.md5("text").alias("row_digest")).join(words, "row_digest").dropDuplicates(["row_digest"])

    def compute(part):
        out = []
        for text, own in zip(part.column("text").to_pylist(), part.column("words").to_pylist()):
            wanted = set(own)
            out.append([{"start": a, "end": b} for w, a, b in words_outside(text, base_spans(text)) if w in wanted])
        return [out]

    return with_computed(texts, ddl("terms array<struct<start: int, end: int>>"), compute).select("row_digest", "terms")


def find_personal_data(docs: DataFrame, threshold: float = 0.5, support: int = 3, width: int = 5) -> DataFrame:
    """doc_id, row_digest, base spans and terms (spans of words that disclose an entity of the text, by start) of each row of docs."""
    found = staged(find_base(docs, width), "found")
    terms = disclosing_terms(docs, found, threshold, support)
    added = staged(disclosed_places(docs, found, terms), "terms")
    rows = found.select("doc_id", "row_digest", "spans")
    # Most rows hold nothing: they would meet under one null key.
    empty = rows.filter("row_digest is null").withColumn("terms", F.lit(None).cast(added.schema["terms"].dataType))
    return rows.filter("row_digest is not null").join(added, "row_digest", "left").select("doc_id", "row_digest", "spans", "terms").union(empty.select("doc_id", "row_digest", "spans", "terms"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts a kind, the digest of the base spans, and all spans as text."""

    def say(rows):
        return ",".join(f"{(*KINDS, 'term')[k]}:{a}:{b}" for a, k, b in rows)

    def compute(part):
        counts, shas, alls = [[] for _ in KINDS], [], []
        for spans, terms in zip(part.column("found").to_pylist(), part.column("terms").to_pylist()):
            base = [(s["start"], s["kind"], s["end"]) for s in spans]
            for k, c in enumerate(counts):
                c.append(sum(x[1] == k for x in base))
            shas.append(hashlib.sha256(say(base).encode()).hexdigest())
            alls.append(say(sorted(base + [(t["start"], len(KINDS), t["end"]) for t in terms or []])))
        return [*counts, shas, alls]

    fields = ddl("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
    return with_computed(found.withColumnRenamed("spans", "found"), fields, compute, text=None).select("doc_id", *fields.names)


def masked(text: str, marks: list[tuple[int, int, str]]) -> str:
    """text with marks (from, to, name) put in; marks that overlap become one, named after the first."""
    joined: list[list] = []
    for a, b, name in sorted(marks):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b, name])
    out, end = [], 0
    for a, b, name in joined:
        out += [text[end:a], f"[{name}]"]
        end = b
    return "".join([*out, text[end:]])


@keeps_columns
def redact(docs: DataFrame, threshold: float = 0.5, support: int = 3, width: int = 5) -> DataFrame:
    """docs with [EMAIL], [IP], [CARD] and [PHONE] in place of entities and [TERM] in place of disclosing words; the columns stay as they are."""
    found = staged(find_base(docs, width), "found")
    terms = disclosing_terms(docs, found, threshold, support)
    added = disclosed_places(docs, found, terms).withColumnsRenamed({"terms": "disclosing_terms", "row_digest": "digest_of_text"})

    def compute(part):
        out = []
        for text, extra in zip(part.column("text").to_pylist(), part.column("disclosing_terms").to_pylist()):
            if text:
                marks = [(a, b, KINDS[k].upper()) for a, k, b in base_spans(text)]
                text = masked(text, marks + [(t["start"], t["end"], "TERM") for t in extra or []])
            out.append(text)
        return [out]

    joined = docs.join(staged(added, "terms"), F.md5(docs.text) == F.col("digest_of_text"), "left")
    done = with_computed(joined, ddl("redacted_text string"), compute).withColumn("text", F.col("redacted_text"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)

"""Quality rules as weak supervision: each rule votes good, bad or abstains; expectation-maximisation
estimates how well each rule tells good from bad; the posterior probability of "good" decides.

DataFrame functions only. Spark counts the vote patterns (at most 3**rules of them, whatever the input);
the estimation runs on those counts in plain Python and its result goes back as a table of patterns.

Null text has no words; empty and null texts fail the base rules (under 50 words); an empty table gives no
rows; repeated rows are judged each by itself; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import keeps_columns, staged

SPACE = r"[\x20\x09-\x0D]+"
GOOD, BAD, ABSTAIN = 1, -1, 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, though the body names it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of three that occur twice or more.

    If all hashes differ there are none. Else the windows are sorted with their places; each place of a
    repeated window covers three words, less those that the next place covers again.
    """

    def window(w, i):
        return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    def places(w):
        return F.sequence(F.lit(0), F.size(w) - 3)

    def among_sorted(o):
        same = lambda j, k: F.get(o, j)["text"] == F.get(o, k)["text"]
        found = F.transform(F.sequence(F.lit(0), F.size(o) - 1), lambda j: F.when(same(j, j - 1) | same(j, j + 1), F.get(o, j)["at"]))
        return let(F.sort_array(F.filter(found, lambda x: x.isNotNull())), covered)

    def covered(p):
        steps = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda acc, j: acc + F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(3))))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(steps)

    def count(w):
        hashes = F.transform(places(w), lambda i: F.xxhash64(*window(w, i)))
        ordered = F.sort_array(F.transform(places(w), lambda i: F.struct(F.concat_ws(" ", *window(w, i)).alias("text"), i.alias("at"))))
        unique = let(hashes, lambda h: F.size(h) == F.size(F.array_distinct(h)))
        return F.when(F.size(w) < 4, F.lit(0)).when(unique, F.lit(0)).otherwise(let(ordered, among_sorted))

    return let(words, count)


def document_signals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and the counts that the rules use."""
    text = F.coalesce("text", F.lit(""))
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_word = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.aggregate(w, F.lit(0), lambda acc, x: acc + F.length(x)).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_key"), by_word.alias("w"), by_line.alias("l"), without(r"[#*$%&|<>]").alias("n_symbols"), without("[A-Z]+").alias("n_upper"), without("[.!?]+").alias("n_stops"), F.length(text).alias("n_text"))
    longs = ["w.n_words", "w.word_chars", "w.n_repeat_words", "l.n_lines", "l.n_dup_lines", "n_symbols", "n_upper", "n_stops", "n_text"]
    return counted.select("doc_id", "text_key", *[F.col(c).cast("long").alias(c.rpartition(".")[2]) for c in longs])


def rule_votes() -> dict[str, Column]:
    """Each rule's vote on a row of document_signals(). Six rules call faults bad and abstain otherwise; the last calls ordinary prose good."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_text"), F.lit(1))
    col = F.col
    fault = lambda bad: F.when(bad, F.lit(BAD)).otherwise(F.lit(ABSTAIN))
    prose = (50 * col("n_symbols") <= n) & (5 * col("n_upper") < c) & (10 * col("n_repeat_words") <= 3 * n) & (4 * col("n_stops") <= n)
    return {
        "word_length": fault((col("word_chars") < 2 * n) | (col("word_chars") > 14 * n)),
        "symbols": fault(10 * col("n_symbols") > n),
        "upper": fault(2 * col("n_upper") > c),
        "dup_lines": fault(2 * col("n_dup_lines") > col("n_lines")),
        "repeats": fault(10 * col("n_repeat_words") > 4 * n),
        "stops": fault((2 * col("n_stops") > n) | ((n >= 100) & (col("n_stops") == 0))),
        "prose": F.when(prose, F.lit(GOOD)).otherwise(F.lit(ABSTAIN)),
    }


def fit_rules(patterns: list[tuple[tuple[int, ...], int]], prior: float = 0.5, accuracy: float = 0.8, trust: float = 0.25, rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Posterior probability of good for each vote pattern, from (votes, count) pairs.

    A rule that votes is right with a chance of its own; abstaining says nothing. The chances start at
    accuracy, which also weighs in each round as trust times the rule's votes, at every size alike. They
    are learnt from how the rules agree; ties and order don't matter, as patterns are sorted first.
    """
    patterns = sorted((votes, n) for votes, n in patterns if n)
    if not patterns:
        return {}
    rules = range(len(patterns[0][0]))
    right, posterior = [accuracy for _ in rules], {}
    for _ in range(rounds):
        moved = 0.0
        for votes, _n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(votes[r] * math.log(right[r] / (1 - right[r])) for r in rules)
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            moved = max(moved, abs(p - posterior.get(votes, 2.0)))
            posterior[votes] = p
        for r in rules:
            cast = [(v, n) for v, n in patterns if v[r] != ABSTAIN]
            mass = sum(n for _, n in cast)
            agreed = sum(n * (posterior[v] if v[r] == GOOD else 1 - posterior[v]) for v, n in cast)
            right[r] = min(0.999, max(0.5, (agreed + (trust * mass + 1) * accuracy) / (mass * (1 + trust) + 1)))
        if moved < 1e-9:
            break
    return posterior


def judge_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_key, the signals, base_failed, p_good and kept of every row of docs."""
    spark = docs.sparkSession
    votes = rule_votes()
    signals = staged(document_signals(docs), "signals")
    voted = signals.withColumns({f"v_{k}": v for k, v in votes.items()})
    names = [f"v_{k}" for k in votes]
    counts = [(tuple(row[n] for n in names), row["count"]) for row in voted.groupBy(*names).count().collect()]  # 3**rules rows at most
    posterior = fit_rules(counts)
    schema = ", ".join([*(f"{n} int" for n in names), "p_good double"])
    table = spark.createDataFrame([(*v, p) for v, p in sorted(posterior.items())], schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = voted.join(F.broadcast(table), names, "left").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop(*names)


@keeps_columns
def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept; the columns stay as they are."""
    good = staged(judge_quality(docs, threshold).filter("kept").select(F.col("doc_id").alias("good_id"), "text_key"), "good")
    keyed = docs.withColumn("good_key", F.xxhash64("text"))
    return keyed.join(good, keyed.doc_id.eqNullSafe(good.good_id) & (keyed.good_key == good.text_key), "left_semi").select(*docs.columns)

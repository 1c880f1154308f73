"""Filter interaction audit: what each filter removes, for every order in which the filters can be applied.

Spark counts the masks of failed filters in each part; from then on a part is at most 2**filters rows. Each part's
counts become a decision diagram: one level a filter, a node's two edges lead to what passes and what fails it, equal
subdiagrams are one node, leaves hold counts (all, labelled good, labelled toxic). Swapping two neighbouring levels
turns the diagram for one order into that for the next; swaps along a chain of all permutations visit every order.
Along the all-pass path of an order, the fail edge of step i weighs what the filter removes there.

Null text is an empty one, null `lang` the part of the empty string. A document is a copy if a smaller doc_id has the
same text anywhere in the table; a null doc_id is neither smaller than another nor a copy. Repeated rows of one doc_id
and text are no copies of each other and count each. A document labelled twice is good (toxic) if any label says so.
Empty tables give no rows. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from .common import ddl, map_texts, staged, text_column

FILTERS = "ABCDE"
UPPER = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"
STEPS = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def failures(text: str) -> int:
    """Bit i is set if the text fails filter i of ABCD (E needs the other texts)."""
    raw = text.encode()
    words = raw.split()  # at ASCII white space
    upper = len(raw) - len(raw.translate(None, UPPER))
    fails = len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 3 * len(text), len(raw.translate(None, SYMBOLS)) < len(raw)
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def failed_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit i: fails filter i of ABCDE) with n, the rows alike in all three and in text."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), "text")
    fields = [f for f in keyed.schema if f.name != "text"]

    def judge(batches):
        for part in batches:
            yield [*(part.column(f.name) for f in fields), [failures(t) for t in text_column(part, "text")]]

    judged = map_texts(keyed, T.StructType([*fields, *ddl("mask int").fields]), judge)
    rows = staged(judged.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "masks")
    # The first id of a text is joined by text and id, so that a text with many copies is many keys.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", F.when(copy, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"), "n", "digest")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: at most 32 rows a part."""
    told = labels.groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic")).withColumn("salt", F.lit(0))
    # Rows without an id have no label; the salt keeps them from meeting in one task.
    salted = failed_masks(docs).withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096)).cast("int") + 1).otherwise(0))
    both = salted.join(told, ["doc_id", "salt"], "left")
    lost = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("good"), lost("toxic"))


class Diagram:
    """A decision diagram of counts: nodes of a level are pairs (passes, fails) of nodes of the next one, equal ones once; leaves are tuples of counts."""

    def __init__(self, order: str, counts: dict[int, tuple[int, ...]], width: int):
        self.order = list(order)
        self.levels: list[dict] = [{} for _ in order]  # of each level: (passes, fails) -> node number
        self.pairs: list[list] = [[] for _ in order]
        self.leaves: list[tuple[int, ...]] = []
        self.leaf_ids: dict[tuple[int, ...], int] = {}
        self.zero = (0,) * width
        self.root = self._built(0, 0, counts)

    def _leaf(self, value: tuple[int, ...]) -> int:
        if value not in self.leaf_ids:
            self.leaf_ids[value] = len(self.leaves)
            self.leaves.append(value)
        return self.leaf_ids[value]

    def _node(self, level: int, passes: int, fails: int) -> int:
        if (passes, fails) not in self.levels[level]:
            self.levels[level][passes, fails] = len(self.pairs[level])
            self.pairs[level].append((passes, fails))
        return self.levels[level][passes, fails]

    def _built(self, level: int, mask: int, counts: dict) -> int:
        if level == len(self.order):
            return self._leaf(counts.get(mask, self.zero))
        bit = 1 << FILTERS.index(self.order[level])
        return self._node(level, self._built(level + 1, mask, counts), self._built(level + 1, mask | bit, counts))

    def swap(self, level: int) -> None:
        """Swaps a level with the next one; levels above and below keep their nodes' numbers and content."""
        upper, lower = self.pairs[level], self.pairs[level + 1]
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        self.levels[level + 1], self.pairs[level + 1] = {}, []
        self.levels[level], self.pairs[level] = {}, []
        for passes, fails in upper:  # in order, and all different: numbers stay
            (pp, pf), (fp, ff) = lower[passes], lower[fails]
            self._node(level, self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))

    def weights(self) -> list[list[tuple[int, ...]]]:
        """Of each level's nodes, then of the leaves, the counts of all that lies below."""
        found = [self.leaves]
        for pairs in reversed(self.pairs):
            found.append([tuple(a + b for a, b in zip(found[-1][p], found[-1][f])) for p, f in pairs])
        return found[::-1]

    def all_pass(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """(kept, removed) of each step: the weights of the two edges along the path on which everything passes."""
        weights, at, steps = self.weights(), self.root, []
        for level, pairs in enumerate(self.pairs):
            passes, fails = pairs[at]
            steps.append((weights[level + 1][passes], weights[level + 1][fails]))
            at = passes
        return steps


def neighbour_swaps(n: int) -> list[int]:
    """Places i such that swapping i and i + 1, one after another, visits every permutation of n once."""
    if n < 2:
        return []
    inner, out, down = neighbour_swaps(n - 1), [], True
    for step in [*inner, None]:
        out += range(n - 2, -1, -1) if down else range(n - 1)
        if step is not None:
            out.append(step + 1 if down else step)
        down = not down
    return out


def every_order(counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders and steps, from the counts of a part's masks."""
    diagram = Diagram(FILTERS, counts, 3)
    paths = {"".join(diagram.order): diagram.all_pass()}
    for level in neighbour_swaps(len(FILTERS)):
        diagram.swap(level)
        paths["".join(diagram.order)] = diagram.all_pass()
    fails, alone, shapley = dict.fromkeys(FILTERS, 0), dict.fromkeys(FILTERS, 0), dict.fromkeys(FILTERS, 0)
    for order, steps in paths.items():
        fails[order[0]] = steps[0][1][0]  # a first filter removes all that fail it
        alone[order[-1]] = steps[-1][1][0]  # a last one those that fail nothing else
        for f, (_, removed) in zip(order, steps):
            shapley[f] += removed[0]
    return [
        (order, i + 1, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], shapley[f])
        for order, steps in sorted(paths.items()) for i, (f, (kept, removed)) in enumerate(zip(order, steps))
    ]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """STEPS: one row per part, order of filters and step."""

    def steps(key, rows):
        import pandas as pd

        counts = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in rows.itertuples()}
        found = pd.DataFrame(every_order(counts), columns=[c.split()[0] for c in STEPS.split(", ")][1:])
        found.insert(0, "part", key[0])
        return found

    return mask_counts(docs, labels).groupBy("part").applyInPandas(steps, STEPS)

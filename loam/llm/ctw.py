"""Context-tree weighting over bytes: how many bits a text costs under a model of the corpus.

Each byte is eight binary decisions, most significant first. Each decision has a context tree of its own over
the bytes before: a node for every context of up to `depth` bytes that training saw, with a Krichevsky-Trofimov
estimate of its bit. A node's weighted probability is half its own estimate and half the product of its
children's; from these follow the shares with which the estimates of all depths are mixed when a bit is coded.
Where training never saw the deeper context, the deepest seen one stands for it; a decision that was never
seen at all costs one bit.

Texts are coded with A-Z lower-cased, in UTF-8, with an end mark (byte 255, which UTF-8 never uses) that also
fills the context before the first byte.
"""

from __future__ import annotations

END = 255


def spread(texts: list[bytes], depth: int):
    """(grams, counts): the depth + 1 bytes that end at each byte of each text and at its end mark, as integers, the coded byte lowest; and how many each text has."""
    import numpy as np

    pad = bytes([END]) * max(1, depth)
    counts = np.array([len(t) + 1 for t in texts], np.int64)
    step, width = len(pad), depth + 1
    data = b"".join([*(pad + t for t in texts), pad, bytes(8 - width)])
    # Every eight bytes in a row as one integer, most significant first; a gram is the first `width` of them.
    runs = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    # Of each text's padding only the first byte is coded, as the end mark of the text before.
    ends = np.cumsum(counts - 1 + step) + 1 - depth
    keep = np.ones(len(runs), bool)
    keep[: step - depth] = False
    keep[(ends[:, None] + np.arange(step - 1)).ravel() if len(ends) else slice(None)] = False
    grams = runs[keep].astype(np.uint64)
    grams >>= np.uint64(8 * (8 - width))
    return grams, counts


def tally(keys, weights):
    """Sorted distinct keys and the sums of their weights."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(keys) else weights


def log_gamma(x):
    """Stirling's series above 8, the recurrence below."""
    import numpy as np

    x = np.asarray(x, float)
    down, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        down[low] += np.log(y[low])
        y[low] += 1
    inverse = 1 / y
    series = inverse / 12 - inverse**3 / 360 + inverse**5 / 1260
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - down


class Levels:
    """Nodes of some depths: keys (context above decision), share of the node's own estimate in the mix, chance of a 1."""

    def __init__(self):
        self.keys, self.share, self.one = {}, {}, {}

    def add(self, depth, keys, n0, n1, share):
        self.keys[depth], self.share[depth], self.one[depth] = keys, share, (n1 + 0.5) / (n0 + n1 + 1)


def block_log(n0, n1):
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    import numpy as np

    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1)


def combined(own, below):
    """(share, log of the weighted probability) of nodes with the logs of their own block probability and of their children's product."""
    import numpy as np

    return 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.log(0.5) + np.logaddexp(own, below)


def grow(grams, counts, depth: int, lowest: int):
    """(levels, bottom) of the nodes of depth `lowest` to `depth`; bottom: keys, n0, n1 and weighted log of those of depth `lowest`. Contexts that agree in their last `lowest` bytes must all be there."""
    import numpy as np

    levels, weighted, keys_below = Levels(), None, None
    for d in range(depth, lowest - 1, -1):
        own, n = tally(grams & np.uint64((1 << (8 * (d + 1))) - 1), counts.astype(float))
        symbol = own & np.uint64(255)
        keys, ones = [], []
        for k in range(8):
            keys.append(decision(own, k))
            ones.append(n * ((symbol >> np.uint64(7 - k)) & np.uint64(1)))
        node, both = tally(np.concatenate(keys), np.tile(n, 8) + 1j * np.concatenate(ones))
        n1, n0 = both.imag, both.real - both.imag
        block = block_log(n0, n1)
        if weighted is None:
            share, weighted = np.ones(len(node)), block
        else:
            _, below = tally(keys_below & np.uint64((1 << (8 * (d + 1))) - 1), weighted)
            share, weighted = combined(block, below)
        levels.add(d, node, n0, n1, share)
        keys_below = node
    return levels, (node, n0, n1, weighted)


def decision(grams, k: int):
    """Keys of the k-th decision of each gram's lowest byte, after all bytes above it."""
    import numpy as np

    symbol = grams & np.uint64(255)
    return ((grams >> np.uint64(8)) << np.uint64(8)) | ((symbol | np.uint64(256)) >> np.uint64(8 - k))


def cost(levels: Levels, grams, above: tuple | None = None):
    """Bits that the lowest byte of each gram costs after the bytes above it.

    above: what the levels over those given make of it, as sorted keys of the lowest level given and for each
    (added, kept, alone): a chance becomes added + kept * chance, and alone where no level given saw the decision.
    """
    import numpy as np

    bits = np.zeros(len(grams))
    symbol = grams & np.uint64(255)
    for k in range(8):
        whole = decision(grams, k)
        chance, seen = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
        for d in sorted(levels.keys, reverse=True):
            if not len(levels.keys[d]):
                continue
            key = whole & np.uint64((1 << (8 * (d + 1))) - 1)
            at = np.minimum(np.searchsorted(levels.keys[d], key), len(levels.keys[d]) - 1)
            share = np.where(seen, levels.share[d][at], 1.0)
            there = levels.keys[d][at] == key
            chance = np.where(there, share * levels.one[d][at] + (1 - share) * chance, chance)
            seen |= there
        if above is not None:
            keys, added, kept, alone = above
            at = np.searchsorted(keys, whole & np.uint64((1 << (8 * (min(levels.keys) + 1))) - 1))
            chance = np.where(seen, added[at] + kept[at] * chance, alone[at])
        one = (symbol >> np.uint64(7 - k)) & np.uint64(1)
        bits -= np.log2(np.where(one == 1, chance, 1 - chance))
    return bits


class GramCosts:
    """The costs of some grams."""

    def __init__(self, grams, bits, depth: int):
        import numpy as np

        order = np.argsort(grams)
        self.grams, self.bits, self.depth = grams[order], bits[order].astype(np.float32), depth

    def places(self, grams):
        """(places, absent): where the table has each gram, and which it doesn't have."""
        import numpy as np

        if not len(self.grams):
            return np.zeros(len(grams), np.int64), np.ones(len(grams), bool)
        at, order = np.empty(len(grams), np.int64), np.argsort(grams)  # in order, neighbours are found near each other
        at[order] = np.minimum(np.searchsorted(self.grams, grams[order]), len(self.grams) - 1)
        return at, self.grams[at] != grams

    def text_bits(self, texts: list[bytes], rest: GramCosts | None = None):
        """Bits of each text; what this table doesn't have, rest must."""
        import numpy as np
        import pyarrow as pa

        grams, counts = spread(texts, self.depth)
        coded = pa.array(grams).dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False)
        at, absent = self.places(own)
        bits = self.bits[at].astype(float) if len(self.bits) else np.zeros(len(own))
        if absent.any():
            where, lost = rest.places(own[absent]) if rest else (None, absent)
            if lost.any():
                raise ValueError("a text has a gram without a cost: it was read differently before")
            bits[absent] = rest.bits[where]
        bits = bits[coded.indices.to_numpy(zero_copy_only=False)]
        return np.add.reduceat(bits, np.cumsum(counts) - counts) if len(counts) else np.zeros(0)

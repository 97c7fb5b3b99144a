"""Class-conditional Kneser-Ney models of the letters of words."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

#: Letters a context has at most, and the discount for the classes' own counts (the shared levels use the same).
CONTEXT, DISCOUNT = 5, 0.75
#: Letters that the shared model weighs as beside a class's own counts.
SHARED = 16.0
#: Evidence (in nats) of a letter that isn't worth an entry of its own.
NEAR = 1e-3
ONE, FEW = (1 << 32) - 1, (1 << 20) - 1
BEGIN, END = "\x02", "\x03"


def contexts(word: str) -> Iterator[tuple[str, str]]:
    """(context, letter) for each letter of a word and its end."""
    s = f"{BEGIN}{word}{END}"
    for i in range(1, len(s)):
        yield s[max(0, i - CONTEXT) : i], s[i]


class Shared:
    """Interpolated Kneser-Ney over both classes: a letter's count below the top is the number of contexts it continues."""

    def __init__(self, grams: Iterable[tuple[str, str]]):
        self.count: list[dict[str, int]] = [defaultdict(int) for _ in range(CONTEXT + 1)]
        self.total: list[dict[str, int]] = [defaultdict(int) for _ in range(CONTEXT + 1)]
        self.kinds: list[dict[str, int]] = [defaultdict(int) for _ in range(CONTEXT + 1)]
        level = {h + w for h, w in grams}
        while level:
            lower = set()
            for g in level:  # each is one context in which its shorter form occurs
                if len(g) > 1:
                    short = g[1:]
                    k = len(short) - 1
                    if not self.count[k][short]:
                        self.kinds[k][short[:-1]] += 1
                        lower.add(short)
                    self.count[k][short] += 1
                    self.total[k][short[:-1]] += 1
            level = lower
        self.letters = max(1, self.kinds[0].get("", 0)) + 1

    def probability(self, context: str, letter: str) -> float:
        p = 1.0 / self.letters
        for k in range(min(len(context), CONTEXT) + 1):
            h = context[len(context) - k :]
            if n := self.total[k].get(h):
                p = (max(self.count[k].get(h + letter, 0) - DISCOUNT, 0) + DISCOUNT * self.kinds[k][h] * p) / n
        return p


class Ratio:
    """log P(word | class 1) - log P(word | class 0), both of which back off to what the classes share.

    A class's own counts, discounted, are interpolated with the model of both classes' counts together, which weighs as
    much as SHARED letters more: a rare expression says little, and where neither class knows a context, nothing.
    Letters whose evidence differs by no more than NEAR from that of an unseen letter after the same context are held as
    such: a word's evidence is exact up to NEAR for each of its letters.
    """

    def __init__(self, counts: Iterable[tuple[str, int, int]]):
        """counts: word, count in class 0, count in class 1.

        Pairs of counts are held as one number each, with 32 bits for class 1: there are many.
        """
        own: dict[str, int] = defaultdict(int)
        total: dict[str, int] = defaultdict(int)
        kinds: dict[str, int] = defaultdict(int)  # letters after a context: of class 0, of class 1, of either; 20 bits each
        for word, n0, n1 in counts:
            n = n0 << 32 | n1
            for h, w in contexts(word):
                own[h + w] += n
        for g, n in own.items():
            h = g[:-1]
            total[h] += n
            kinds[h] += (n > ONE) << 40 | (n & ONE > 0) << 20 | 1
        shared = Shared((g[:-1], g[-1]) for g in own)
        self.seen: dict[str, float] = {}
        self.unseen: dict[str, float] = {}
        for h, t in total.items():
            k = kinds[h]
            self.unseen[h] = math.log((DISCOUNT * (k >> 20 & FEW) + SHARED) / ((t & ONE) + SHARED) / ((DISCOUNT * (k >> 40) + SHARED) / ((t >> 32) + SHARED)))
        for g, n in own.items():
            h = g[:-1]
            t, k = total[h], kinds[h]
            p = ((n >> 32) + (n & ONE) - DISCOUNT + DISCOUNT * (k & FEW) * shared.probability(h[1:], g[-1])) / ((t >> 32) + (t & ONE))
            p1 = (max((n & ONE) - DISCOUNT, 0) + (DISCOUNT * (k >> 20 & FEW) + SHARED) * p) / ((t & ONE) + SHARED)
            p0 = (max((n >> 32) - DISCOUNT, 0) + (DISCOUNT * (k >> 40) + SHARED) * p) / ((t >> 32) + SHARED)
            r = math.log(p1 / p0)
            if abs(r - self.unseen[h]) > NEAR:
                self.seen[g] = r

    def word(self, word: str) -> float:
        seen, unseen = self.seen, self.unseen
        r = 0.0
        for h, w in contexts(word):
            if (x := seen.get(h + w)) is not None:
                r += x
            else:
                r += unseen.get(h, 0.0)
        return r

"""Chinese words by the most probable cut.

A run of Chinese signs is a graph: an edge for each known word that stands there, and one for each single sign. The cut is the path of least cost, a word's cost being
the negative logarithm of its frequency. Signs that this leaves alone next to each other are unknown words: a Viterbi path over the places of signs in words (first,
inner, last, alone) joins them, by how often the known words have each sign in each place. Costs are whole millionths, so that every engine finds the same cut.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Mapping
from functools import lru_cache

#: Pieces of a text: Chinese runs, Latin words and numbers, and single marks.
PIECES = "[一-鿿]+|[A-Za-z0-9]+|[^ \\t\\r\\n\\x0B\\f]"
#: How many words of one to four signs there are among a hundred, before the known words are counted; this library's own choice.
PRIOR = {1: 25, 2: 62, 3: 9, 4: 4}
#: Longer words say nothing of how unknown ones are made: they are expressions, and unknown words are short.
SHORT = 4
#: Signs that unknown ones are taken to be among, and how often each is taken to have been seen in each place beforehand.
SIGNS, SEEN = 20_000, 50
#: Higher than any path's cost.
NEVER = 1 << 50
#: Places of a sign in a word, and those that can stand before each.
FIRST, INNER, LAST, ALONE = range(4)
BEFORE = {FIRST: (LAST, ALONE), INNER: (FIRST, INNER), LAST: (FIRST, INNER), ALONE: (LAST, ALONE)}

_HAN = re.compile("[一-鿿]+")


def cost(part: float, whole: float) -> int:
    return round(-1_000_000 * math.log(part / whole)) if part else NEVER


class Segmenter:
    """words: the cost of each; alone: that of an unknown sign by itself; start, move, signs, unknown: of places."""

    def __init__(self, frequencies: Mapping[str, int]):
        """Frequencies of known words; those that are no Chinese run or not above 0 are left out."""
        known = {w: n for w, n in frequencies.items() if n > 0 and _HAN.fullmatch(w)}
        total = sum(known.values()) + 1
        self.words = {w: cost(n, total) for w, n in known.items()}
        self.alone = cost(1, total)
        self.longest = max(map(len, known), default=1)
        # by the first two signs: how long the known words are that begin so
        self.begins: dict[str, tuple[int, ...]] = {}
        for size in sorted({len(w) for w in known if len(w) > 1}):
            self.begins |= {b: (*self.begins.get(b, ()), size) for b in {w[:2] for w in known if len(w) == size}}
        lengths, seen = Counter({n: share * total / 100 for n, share in PRIOR.items()}), [Counter() for _ in range(4)]
        for w, n in known.items():
            if len(w) > SHORT:
                continue
            lengths[len(w)] += n
            for k, sign in enumerate(w):
                seen[ALONE if len(w) == 1 else FIRST if k == 0 else LAST if k == len(w) - 1 else INNER][sign] += n
        one, several = lengths[1], sum(n for k, n in lengths.items() if k > 1)
        longer, inner = sum(n for k, n in lengths.items() if k > 2), sum((k - 2) * n for k, n in lengths.items() if k > 2)
        self.start = [cost(several, one + several), NEVER, NEVER, cost(one, one + several)]
        begin = {FIRST: self.start[FIRST], ALONE: self.start[ALONE]}
        self.move = {LAST: begin, ALONE: begin, FIRST: {LAST: cost(lengths[2], several), INNER: cost(longer, several)}, INNER: {LAST: cost(longer, inner), INNER: cost(inner - longer, inner)}}
        whole = [sum(c.values()) + SEEN * SIGNS for c in seen]
        self.unknown = [cost(SEEN, n) for n in whole]
        self.signs = {s: [cost(seen[p][s] + SEEN, whole[p]) for p in range(4)] for s in sorted(set().union(*seen))}

    def path(self, run: str) -> list[str]:
        """The cheapest cut of a run into known words and single signs; of equal ones, that whose first word is longer."""
        n = len(run)
        best, size = [0] * (n + 1), [1] * n
        words, begins, alone = self.words.get, self.begins.get, self.alone
        for i in range(n - 1, -1, -1):
            least = words(run[i], alone) + best[i + 1]
            for k in begins(run[i : i + 2], ()):
                if k > n - i:
                    break
                own = words(run[i : i + k])
                if own is not None and own + best[i + k] <= least:
                    least, size[i] = own + best[i + k], k
            best[i] = least
        out, i = [], 0
        while i < n:
            out.append(run[i : i + size[i]])
            i += size[i]
        return out

    def joined(self, signs: str) -> list[str]:
        """An unknown stretch cut by the cheapest path of places; of equal ones, that of the earlier place in the order above, from the end."""
        signs_of, unknown, back = self.signs.get, self.unknown, []
        begin, single = self.start[FIRST], self.start[ALONE]
        inward, end, on, close = self.move[FIRST][INNER], self.move[FIRST][LAST], self.move[INNER][INNER], self.move[INNER][LAST]
        first, inner, last, alone = map(operator.add, self.start, signs_of(signs[0], unknown))
        for s in signs[1:]:
            # written out place by place: before a first or single sign stands a last or single one, before the others a first or inner one
            a, b, c, d = signs_of(s, unknown)
            word, after = (LAST, last) if last <= alone else (ALONE, alone)
            mid, to_inner = (FIRST, first + inward) if first + inward <= inner + on else (INNER, inner + on)
            tail, to_last = (FIRST, first + end) if first + end <= inner + close else (INNER, inner + close)
            first, inner, last, alone = after + begin + a, to_inner + b, to_last + c, after + single + d
            back.append((word, mid, tail, word))
        place = LAST if last <= alone else ALONE
        ends = [len(signs)]
        for k in range(len(signs) - 1, 0, -1):
            place = back[k - 1][place]
            if place in (LAST, ALONE):
                ends.append(k)
        return [signs[a:b] for a, b in zip([0, *ends[:0:-1]], ends[::-1], strict=True)]

    def run(self, run: str) -> list[str]:
        out, alone = [], ""
        for w in [*self.path(run), ""]:
            if len(w) == 1:
                alone += w
                continue
            out += self.joined(alone) if len(alone) > 1 and alone not in self.words else list(alone)
            alone = ""
            out.append(w)
        return out[:-1]

    def cut(self, text: str) -> list[str]:
        """The words of a text, and its marks."""
        keep, out = _kept(self), []
        for piece in re.findall(PIECES, text):
            out += keep(piece) if _HAN.match(piece) else [piece]
        return out


@lru_cache(4)
def _kept(segmenter: Segmenter):
    """Runs repeat: their words are kept, up to a bound."""
    return lru_cache(1 << 15)(segmenter.run)

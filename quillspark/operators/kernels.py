"""Counts over one text at a time, for batches of texts.

Counting tokens, signs and their runs has no form in built-in functions but higher-order ones, which the engine interprets element by
element: measured at a tenth of this speed or less.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections import Counter
from collections.abc import Iterable

from ..functions.packs import PUNCTUATION, Pack
from ..functions.phrases import Book, Occurrences

#: Terms of a pair of paragraphs that are compared, at most: those that both together have most often.
MOST_TERMS = 100
#: Entries of a lexical vector.
BUCKETS = 32

_RARE = (1 + math.log(1.5)) ** 2
#: Tokens of which a kernel remembers what they count as, at most.
REMEMBERED = 200_000
#: Patterns that have this may fit a sentence and not the paragraph around it.
ANCHORED = re.compile(r"[\\^$]|\(\?[^:]")
#: White space at the ends of texts that goes.
STRIPPED = " \t\r\n\x0b\f\u00a0\u3000"


#: By sum: what each count up to it adds to an entropy; of sums up to MOST_PARTS.
_PARTS: dict[int, list[float]] = {}
MOST_PARTS = 1000
#: How near n times an entropy is to a whole number where its last bit may decide: such entropies are fractions, as the bounds of zones and halves of printed places are.
WHOLE = 1e-8


def entropy(counts: Iterable[int], n: int) -> float:
    """Shannon entropy in bits; 0 without values. From shares, so that halves and quarters give exact bits, as the bounds of zones are."""
    if n > MOST_PARTS:
        return sum([c / n * math.log2(n / c) for c in counts])
    if n not in _PARTS:
        _PARTS[n] = [0.0, *(c / n * math.log2(n / c) for c in range(1, n + 1))]
    return sum(map(_PARTS[n].__getitem__, counts)) if n else 0.0


def sign_entropy(signs: dict[str, int], n: int) -> float:
    """The entropy of counted signs, which stand in the order of their first places. Where it is a fraction with n below, with the last bit that SQL has: that of a sum by fused steps in the order of SQL's table of signs."""
    found = entropy(signs.values(), n)
    if abs(found * n - round(found * n)) > WHOLE:
        return found
    total = 0.0
    for c in map(signs.__getitem__, tabled(signs)):
        total = math.fma(c / n, math.log2(n / c), total)
    return total


#: Sizes to which a table of signs grows, each when it is full.
_SIZES = (13, 29, 59, 127, 257, 541, 1109, 2357, 5087, 10273, 20753, 42043, 85229)


def _mixed(sign: str) -> int:
    """The number by which SQL places a sign of up to four bytes."""
    once = lambda x: x * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    own = sign.encode("utf-8", "surrogatepass")
    x = once(0xE17A1465 ^ (len(own) * 0xC6A4A7935BD1E995 & 0xFFFFFFFFFFFFFFFF) ^ int.from_bytes(own, "little"))
    x = once(x ^ x >> 32)
    x = once(x ^ x >> 32)
    return x ^ x >> 32


def tabled(signs: Iterable[str]) -> list[str]:
    """Signs in the order in which SQL's table of counts lists them after they came in the given one: a chained hash table in which a new chain goes before all others and a new sign first in its chain."""
    follows: dict[str | None, str | None] = {None: None}  # None: before the first
    before: dict[int, str | None] = {}  # by place: what the chain there follows

    def put(sign: str, size: int) -> None:
        place = _MIXED[sign] % size
        if place not in before:
            before[place] = None
            if follows[None] is not None:
                before[_MIXED[follows[None]] % size] = sign
        follows[sign], follows[before[place]] = follows[before[place]], sign

    size = _SIZES[0]
    for k, sign in enumerate(signs):
        if k == size:
            size = next(x for x in _SIZES if x > k)
            old = _listed(follows)
            before.clear()
            follows.clear()
            follows[None] = None
            for x in old:
                put(x, size)
        put(sign, size)
    return _listed(follows)


def _listed(follows: dict) -> list:
    out, at = [], follows[None]
    while at is not None:
        out.append(at)
        at = follows[at]
    return out


def counted_signs(text: str) -> dict[str, int]:
    """How often each sign stands in a text, in the order of their first places."""
    return {c: text.count(c) for c in dict.fromkeys(text)} if len(text) < 2000 else Counter(text)


def spread(numbers: list[int]) -> float:
    """Population standard deviation, by Welford's recurrence in the given order: the same last bit as SQL has, which decides at the bounds of zones."""
    n, mean, square = 0, 0.0, 0.0
    for x in numbers:
        n += 1
        far = x - mean
        mean += far / n
        square += (x - mean) * far
    return math.sqrt(square / n)


#: Of the logarithms of the first ranks: themselves, their sums and the sums of their squares.
_LOGS, _SUMS, _SQUARES = [0.0], [0.0, 0.0], [0.0, 0.0]


def _ranks(n: int) -> None:
    """Makes those up to rank n."""
    for k in range(len(_LOGS) + 1, n + 1):
        v = math.log(k)
        _LOGS.append(v)
        _SUMS.append(_SUMS[-1] + v)
        _SQUARES.append(_SQUARES[-1] + v * v)


#: What is left of 1 - R squared where points lie on a line: its sign decides whether it is in a range from 0.
STRAIGHT = 1e-10


def straight(ys: list[float]) -> float:
    """1 - R squared of the logarithms of ranks with ys, by SQL's recurrences for a covariance, in fused steps, and two variances: the same last bit."""
    mx = my = both = vx = vy = 0.0
    for n, (x, y) in enumerate(zip(_LOGS, ys), 1):
        dx, dy = x - mx, y - my
        mx += dx / n
        my += dy / n
        both = math.fma(dx, y - my, both)
        vx += dx * (x - mx)
        vy += dy * (y - my)
    n = len(ys)
    return 1 - (both / n / (math.sqrt(vx / n) * math.sqrt(vy / n))) ** 2


def needed(pattern: str) -> str:
    """Signs that stand in whatever a pattern of plain signs and classes fits; none for other patterns."""
    return "" if re.search(r"[\\.*+?{}()|^$]", pattern) else max(re.split(r"\[[^\]]*\]", pattern), key=len)


class Remembered(dict):
    """What a function gives of tokens, kept up to a bound."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = found = self.of(token)
        return found


#: By sign: _mixed() of it.
_MIXED = Remembered(_mixed)
#: By what a term's count is moved to stand beside that of content words in one number.
TERM = 32


class Kernel:
    """What a pack counts, with its patterns compiled."""

    def __init__(self, pack: Pack):
        self.pack = pack
        self.token, self.sentence, self.term = re.compile(pack.token), re.compile(pack.sentence), re.compile(pack.term)
        self.edge, self.concept = re.compile(pack.edge), re.compile(pack.concept)
        self.connectors, self.slop = Occurrences(pack.all_connectors), Occurrences(pack.dense_slop)
        # what sentences have in common with their paragraph: first looked for there, as most have none
        self.groups = [frozenset(p for p in own if p) for own in (*(pack.connectors[k] for k in ("high", "medium", "low")), pack.all_slop)]
        self.book = Book(p for own in self.groups for p in own)
        self.templates = [([(needed(p), re.compile(p)) for p in parts], len(parts) * 0.6, round(w * 100)) for parts, w in pack.templates]
        self.starters, self.formulas = [re.compile(p) for p in pack.starters], [re.compile(p) for p, _, _ in pack.formulas]
        self.anywhere = [not ANCHORED.search(p) for p, _, _ in pack.formulas]
        self.stop, self.points, self.number = set(pack.stopwords), frozenset(PUNCTUATION), re.compile("[0-9]+")
        self.kinds, self.buckets = Remembered(self.kind), Remembered(lambda w: (len(w) * 5 + ord(w[0]) + ord(w[-1])) % BUCKETS)
        self.last: tuple[str | None, Counter] = (None, Counter())

    def kind(self, token: str) -> int:
        """1 for a content word, and 1 moved by TERM for a term."""
        plain = token not in self.stop
        return (plain and len(token) >= 2 and not self.number.fullmatch(token)) + ((plain and bool(self.term.match(token))) << TERM)

    def counted(self, text: str) -> Counter:
        """The tokens of a text; the last one's are kept, as the paragraph before a paragraph is often the row before it."""
        if text != self.last[0]:
            self.last = text, Counter(self.tokens(text))
        return self.last[1]

    def tokens(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.pack.cutter.cut(text.lower()) if self.pack.cutter else self.token.findall(text.lower())

    def sentences(self, text: str) -> list[str]:
        """Those above the least length, in order."""
        least = self.pack.least_sentence
        return [s for x in self.sentence.split(text) if len(s := x.strip(STRIPPED)) > least]

    @staticmethod
    def similarity(a: Iterable[str], b: Iterable[str], most: int = MOST_TERMS) -> float:
        """Of two lists of tokens, or of their counts."""
        x, y = (c if isinstance(c, Counter) else Counter(c) for c in (a, b))
        both = x.keys() & y.keys()
        if len(x) + len(y) - len(both) > most:
            total = {**x, **y}
            for t in both:
                total[t] += x[t]
            # those above the least count that still has room, and of that count the first by term
            least = sorted(total.values(), reverse=True)[most - 1]
            first = [t for t, n in total.items() if n > least]
            first += sorted([t for t, n in total.items() if n == least])[: most - len(first)]
            both = both.intersection(first)
            every = [list(filter(None, map(c.get, first))) for c in (x, y)]
        else:
            every = [list(c.values()) for c in (x, y)]
        xy = sum([x[t] * y[t] for t in both])
        if not xy:
            return 0.0
        squares = [(1 - _RARE) * sum([c[t] * c[t] for t in both]) + _RARE * sum(map(operator.mul, own, own)) if len(own) > len(both) else float(sum(map(operator.mul, own, own))) for c, own in zip((x, y), every)]
        return xy / math.sqrt(squares[0] * squares[1])

    @staticmethod
    def zipf(counts: Iterable[int], total: int) -> float:
        """1 - R squared of a straight line through the logarithms of rank and frequency; 0 for few words or equal frequencies."""
        counts = list(counts)
        n = len(counts)
        if total < 20 or n < 3:
            return 0.0
        _ranks(n)
        ys = [math.log(c) for c in sorted([c for c in counts if c > 1], reverse=True)]  # those of single words are 0
        x, y = _SUMS[n], sum(ys)
        vx, vy = n * _SQUARES[n] - x * x, n * sum([v * v for v in ys]) - y * y
        if vx <= 1e-12 or vy <= 1e-12:
            return 0.0
        found = 1 - (n * sum(map(operator.mul, _LOGS, ys)) - x * y) ** 2 / (vx * vy)
        return found if abs(found) > STRAIGHT else straight([*ys, *[0.0] * (n - len(ys))])

    @staticmethod
    def again(words: list[str], k: int) -> float:
        """How many runs of k words stand more than once, over all places."""
        n = len(words) - k + 1
        if len(words) < k + 2:
            return 0.0
        runs = list(zip(*(words[j : j + n] for j in range(k))))
        if len(set(runs)) == n:
            return 0.0
        return sum([c > 1 for c in Counter(runs).values()]) / n

    def values(self, text: str | None, before: str | None, tokens: list[str] | None = None, sentences: list[str] | None = None) -> tuple[float, ...]:
        """The twelve statistics in order; a null text is an empty one, and null before it means no comparison. Tokens and sentences may be given, if they are known."""
        text = text or ""
        known = self.counted(before) if before else None
        tokens = self.tokens(text) if tokens is None else tokens
        lengths, chars = [len(s) for s in (self.sentences(text) if sentences is None else sentences)], counted_signs(text)
        own = Counter(tokens)
        self.last = text, own
        words = [t for t in tokens if len(t) >= 2]
        counts = [n for t, n in own.items() if len(t) >= 2]
        bare = len(text) - chars.pop(" ", 0) - chars.pop("\n", 0)
        signs = {c: k for c, k in chars.items() if c in self.points}
        found = sum(map(operator.mul, map(self.kinds.__getitem__, own), own.values()))
        content, terms = found & (1 << TERM) - 1, found >> TERM
        per = lambda a, b, k: a * k / b if b else 0.0
        twice = self.again(words, 2)
        return (
            spread(lengths) if len(lengths) >= 3 else 0.0,
            per(self.connectors.total(text), len(text), 1000.0),
            per(content, len(tokens), 1.0),
            per(terms, bare, 100.0),
            self.similarity(own, known) if known is not None else 0.0,
            per(counts.count(1), len(words), 1.0),
            self.zipf(counts, len(words)),
            twice,
            self.again(words, 3) if twice else 0.0,  # a run of three has two of two
            sign_entropy(signs, sum(signs.values())),
            sign_entropy(chars, bare),
            per(self.slop.total(text), len(text), 1000.0),
        )

    def sentence_values(self, sentence: str | None) -> tuple[float, float, int, float]:
        """lexical_diversity, char_entropy, word_repetition, unique_char_ratio; 1, 0, 0 and 1 under five characters."""
        sentence = sentence or ""
        bare = sentence.replace(" ", "").replace("\n", "")
        n = len(bare)
        if n < 5:
            return 1.0, 0.0, 0, 1.0
        tokens = self.tokens(bare if self.pack.name == "zh" else sentence)
        kinds, chars = len(set(tokens)), counted_signs(bare)
        often = sum([c >= 3 for c in Counter(tokens).values()]) if len(tokens) - kinds >= 2 else 0
        return kinds / len(tokens) if tokens else 1.0, sign_entropy(chars, n), often, len(chars) / n

    def foretold(self, text: str | None, tokens: list[str] | None = None) -> tuple[float, float]:
        """How well the first half of the tokens foretells the second: perplexity, and the share of words that are new there; -1 under 20 tokens. Tokens may be given, if they are known."""
        tokens = self.tokens(text) if tokens is None else tokens
        if len(tokens) < 20:
            return -1.0, -1.0
        half = len(tokens) // 2
        known, rest = Counter(tokens[:half]), tokens[half:]
        new = math.log2(half + len(known) + 1)
        costs = {w: -math.log2(max(n / half, 1e-8)) for w, n in known.items()}
        # added up plainly, as SQL does: sum() carries what rounding loses, and halves of printed places hang on it
        cost = functools.reduce(operator.add, [costs.get(w, new) for w in rest], 0.0)
        return 2.0 ** (cost / len(rest)), sum(w not in known for w in rest) / len(rest)

    def template(self, text: str) -> float:
        """The weights of all templates of which at least 0.6 of the parts occur, in steps of hundredths."""
        return sum([w for parts, least, w in self.templates if sum([need in text and p.search(text) is not None for need, p in parts]) >= least]) / 100.0

    def starter(self, sentence: str) -> str | None:
        """What the first pattern that fits has captured; null where none does."""
        for p in self.starters:
            if found := p.search(sentence):
                return found.group(1) or ""
        return None

    def marks(self, text: str, sentences: list[str]) -> tuple[tuple, list[tuple]]:
        """Of a paragraph: template, parallel, even and spread (null under three sentences of ten characters); of each sentence: the expressions of each tier of connectors and of slop, whether it has a
        starter, and the place of the first formula that it has, or -1."""
        there = {self.book.phrases[k] for _, k in self.book.trie.iter(text)} if text and self.book.phrases else ()
        groups = [[p for p in there if p in own] for own in self.groups] if there else None
        formulas = [(k, p) for k, (p, free) in enumerate(zip(self.formulas, self.anywhere)) if not free or p.search(text)]
        starts = [self.starter(s) for s in sentences]
        none, each = (0, 0, 0, 0), []
        for s, start in zip(sentences, starts):
            hits = tuple([sum([p in s for p in own]) for own in groups]) if groups else none
            each.append((*hits, start is not None, next((k for k, p in formulas if p.search(s)), -1) if formulas else -1))
        long = [n for s in sentences if (n := len(s)) >= 10]
        far = spread(long) if len(long) >= 3 else None
        parallel = 0.20 if len(sentences) >= 3 and max(Counter(k for k in starts if k is not None).values(), default=0) >= 3 else 0.0
        return (self.template(text), parallel, 0.0 if far is None else 0.10 if far < 5 else 0.06 if far < 8 else 0.0, far), each

    def concepts(self, text: str) -> set[str]:
        """The different concepts of a text."""
        return set(self.concept.findall(text.lower()))

    def vector(self, text: str | None, tokens: list[str] | None = None) -> list[float]:
        """How many words fall into each bucket by length, first and last letter, brought to length 1. Tokens may be given, if they are known."""
        out = [0.0] * BUCKETS
        for k in map(self.buckets.__getitem__, self.tokens(text) if tokens is None else tokens):
            out[k] += 1.0
        norm = max(math.sqrt(sum(map(operator.mul, out, out))), 1e-12)
        return [x / norm for x in out]

    def edges(self, text: str | None) -> tuple[str, str]:
        """The first and last sentence; without one, the first and last 50 characters."""
        text = text or ""
        own = [s for x in self.edge.split(text) if (s := x.strip(STRIPPED))]
        return (own[0], own[-1]) if own else (text[:50], text[-50:])


def char_grams(text: str) -> list[str]:
    """Character 2- to 4-grams within words, which have a space before and after; a word too short for a size gives itself once."""
    out = []
    for w in re.split("[ \t\r\n]+", text.lower()):
        if w:
            own = f" {w} "
            out += [own[i : i + k] for k in (2, 3, 4) for i in range(len(own) - k + 1)]
    return out

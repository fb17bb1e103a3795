"""Many phrases at once: one automaton walks a text, however many phrases there are."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from functools import lru_cache

import ahocorasick

#: Up to so many phrases, one search for each is faster.
FEW = 64


class Book:
    """Phrases in a trie with links to the longest suffix that is one too. Phrases count without overlap, each by itself, as if it were searched for alone. Empty ones never occur."""

    def __init__(self, phrases: Iterable[str]):
        self.phrases = list(dict.fromkeys(p for p in phrases if p))
        self.sizes = [len(p) for p in self.phrases]
        self.trie = ahocorasick.Automaton()
        for k, p in enumerate(self.phrases):
            self.trie.add_word(p, k)
        if self.phrases:
            self.trie.make_automaton()

    def counts(self, text: str | None) -> dict[int, int]:
        """How often each phrase that occurs does, by its number."""
        out: dict[int, int] = {}
        if not text or not self.phrases:
            return out
        free: dict[int, int] = {}
        for end, k in self.trie.iter(text):
            if end - self.sizes[k] >= free.get(k, -1):
                out[k] = out.get(k, 0) + 1
                free[k] = end
        return out

    def present(self, text: str | None) -> int:
        """How many of the phrases occur."""
        return len({k for _, k in self.trie.iter(text)}) if text and self.phrases else 0


class Occurrences:
    """How often phrases occur in all; one that is listed twice counts twice."""

    def __init__(self, phrases: Sequence[str]):
        self.listed = [p for p in phrases if p]
        self.book = Book(self.listed) if len(self.listed) > FEW else None
        if self.book:
            times = Counter(self.listed)
            self.times = [times[p] for p in self.book.phrases]

    def total(self, text: str) -> int:
        if self.book is None:
            return sum(map(text.count, self.listed))
        return sum(n * self.times[k] for k, n in self.book.counts(text).items())


@lru_cache(16)
def book(phrases: tuple[str, ...]) -> Book:
    """A book that stays in the worker, for all batches of a task and the tasks after it."""
    return Book(phrases)

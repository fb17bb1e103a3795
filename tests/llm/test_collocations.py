"""Collocations against SQL and against plain counting with Python's integers."""

import random
import re
from collections import Counter

import oracle
import pytest

from quillspark.llm import collocations as C

SF = "/root/testdata/sf0.001"


def plain(rows, longest=5, least=3, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in found.items():
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        inside = any(o == lang and len(v) > len(w) and b >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for (o, v), b in found.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r, n[lang]))
    return sorted((lang, k, p.decode(), -a, l, r, m, -s) for lang, all_ in out.items() for k, (s, a, p, l, r, m) in enumerate(sorted(all_)[:top], 1))


def found(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, text string, phrase string, rank int, a int")
    return sorted(tuple(r) for r in C.collocations(docs, **how).collect())


def test_oracle(spark):
    oracle.same(C.op12_collocations(spark, SF), C.ORACLES["op12_collocations"], oracle.connect(SF))


@pytest.mark.parametrize("longest, least, top", [(5, 3, 2000), (3, 2, 7), (2, 1, 50), (5, 1, 40)])
def test_brute_force(spark, longest, least, top):
    rng = random.Random(longest)
    words = ["the", "The", "of", "a", "new", "york", "times", "é", "漢", "x\x00y", "…", "Ä"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "!?", " "]
    text = lambda k: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(k))
    rows = [(rng.choice(["en", "de", "", None, "und"]), text(rng.choice([0, 3, 12, 40]))) for _ in range(60)]
    rows += [("en", None), (None, ""), ("fr", " . , "), ("en", "new york times square " * 30), ("de", "immer " * 50), ("de", "a b" + " c" * 200)]
    assert found(spark, rows, longest=longest, least=least, top=top) == plain(rows, longest, least, top)


def test_equal_scores_and_repeated_rows(spark):
    rows = [("en", "p q. r s. t u")] * 5
    got = found(spark, rows, least=5)
    assert got == plain(rows, least=5) and [g[2] for g in got] == ["p q", "r s", "t u"]


@pytest.mark.parametrize("rows", [[], [("en", None)], [("en", "one two three")]])
def test_nothing_frequent(spark, rows):
    assert found(spark, rows) == []


def test_long_text(spark):
    """One text over several slices of bytes, and many rows of one language."""
    rows = [("en", "alpha beta gamma. " * 150_000), *[("en", "beta gamma delta")] * 3000]
    assert found(spark, rows, least=100) == plain(rows, least=100)


def test_arithmetic_beyond_64_bits(spark):
    big = 2_000_000_000_000_003
    f = {"": 7 * big, "a": big, "b": big + 11, "c": 3 * big + 1, "a b": big - 1, "b c": big - 5, "a b c": big - 7}
    rows = [("en", p, len(p.split()), n) for p, n in f.items()]
    got = {r.phrase: r.score for r in C.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()}
    score = lambda p, l, r: 1000 * f[p] * f[""] // (f[l] * f[r])
    assert got == {"a b": score("a b", "a", "b"), "b c": score("b c", "b", "c"), "a b c": min(score("a b c", "a", "b c"), score("a b c", "a b", "c"))}
    # the exact quotient, just under and at a whole number
    rows = [("en", "", 0, 999_999_999_999_999_989), ("en", "a", 1, 999_999_999_999_999_989), ("en", "b", 1, 10**17), ("en", "a b", 2, 10**17 - 1), ("en", "b b", 2, 10**17)]
    got = {r.phrase: r.score for r in C.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()}
    n = 999_999_999_999_999_989
    assert got == {"a b": 1000 * (10**17 - 1) * n // (n * 10**17), "b b": 1000 * 10**17 * n // 10**34}


def test_filter_only_saves_rows(spark, monkeypatch):
    """A filter that is all but full lets rare runs pass; the result is the same."""
    rows = [("en", " ".join(random.Random(k).choices("abcdefgh", k=40))) for k in range(30)]
    want = found(spark, rows, least=4)
    monkeypatch.setattr(C, "FILTER_BITS", 3)
    assert found(spark, rows, least=4) == want == plain(rows, least=4)

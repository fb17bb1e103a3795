import random
import re

import numpy as np
import oracle
import pytest

from quillspark.llm import near_dedup as n
from quillspark.llm._components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(links, nodes):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def brute(rows):
    sets = []
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((d, {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()))
    links = []
    for k, (d, x) in enumerate(sets):
        for e, y in sets[:k]:
            if d is not None and e is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                links.append((d, e))
    root = roots(links, {d for d, _ in rows if d is not None})
    return sorted(((d, len(x), root.get(d), d is None or root[d] == d) for d, x in sets), key=repr)


def texts():
    rng = random.Random(9)
    word = lambda: f"W{rng.randrange(5000)}"
    rows = [(k * 13 % 251, " ".join(word() for _ in range(rng.randint(1, 120)))) for k in range(100)]
    base = [word() for _ in range(150)]
    for k in range(120):  # near copies of one text, many not near each other
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 + k, " ".join(w)))
    passage = [word() for _ in range(60)]
    rows += [(2000 + k, " ".join([*passage, *(word() for _ in range(rng.randint(5, 40)))])) for k in range(80)]  # much in common, mostly too little
    rows += [(3000 + k, rows[7][1].lower()) for k in range(30)]
    rows += [(4000, None), (4001, ""), (4002, " \n"), (4003, "one two"), (4004, "One TWO"), (4005, "one two three four five"), (None, rows[7][1]), (None, "x y")]
    rows += [(4006, "a " * 3000), (4007, "a " * 9), (4003, rows[5][1]), (4003, "one two"), (5000, " ".join(word() for _ in range(20_000)))]
    return rows


@pytest.mark.parametrize("more", [{}, {"few_most": 1, "rounds": 4, "much": 0}, {"few_most": 2, "rounds": 1, "filter_bits": 8}])
def test_brute_force(spark, more, monkeypatch):
    rows = texts()
    if more:
        monkeypatch.setattr(n, "UNDER_HEAD", 7)
        monkeypatch.setattr(n, "BLOCK", 5)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = sorted(map(tuple, n.near_dedup(docs, **more).collect()), key=repr)
    assert got == brute(rows)


def test_words_of_equal_hash(spark):
    a, b = "a", "b"
    for _ in range(10):  # polynomials over their signs agree modulo 2^64 at every odd place
        a, b = a + b, b + a
    rows = [(k, " ".join(f"{x}{i}" for i in range(6))) for k, x in enumerate([a, b, a])]
    got = {r.doc_id: r.component_id for r in n.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert n.near_dedup(docs).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(50)]
    want = {x: r for x, r in roots(links, {x for p in links for x in p}).items() if x != r}
    assert {r.u: r.v for r in components(spark.createDataFrame(links, "u long, v long")).collect()} == want


def test_pruning_bounds():
    least = n.least_matches()
    assert list(least) == sorted(least) and least[0] >= 1 and least[-1] < 0.75 * n.BANDS * n.ROWS
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (20_000, 128), dtype=np.uint64)
    same = np.where(rng.random(a.shape) < 0.75, a, a + 1)
    assert len(n.plausible(a, same)) >= 19_990
    far = np.where(rng.random(a.shape) < 0.4, a, a + 1)
    assert len(n.plausible(a, far)) < 400


def test_oracle(spark, sf):
    oracle.same(n.op4_near_dedup(spark, sf), n.ORACLES["op4_near_dedup"], oracle.connect(sf))

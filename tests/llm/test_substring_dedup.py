import random
import re

import oracle
from quillspark.llm import substring_dedup as s

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    order = lambda d: (d is None, d or 0)
    for d, w in docs:
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, (True, 0)), order(d))
    out = []
    for d, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(d):
                gone.update(range(k, k + window))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "é", "x."]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}"
    run = lambda n: " ".join(word() for _ in range(n))
    passages = [run(n) for n in (13, 14, 20, 60, 200)]
    rows = []
    for k in range(120):
        parts = [run(rng.randint(0, 40)) for _ in range(3)]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), p)
        rows.append((k * 7 % 121, rng.choice([" ", "\n", " \t\n"]).join(parts)))
    rows += [(500 + k, rows[3][1]) for k in range(40)]  # copies
    rows += [(600 + k, run(2) + " " + passages[3] + " " + run(3)) for k in range(60)]  # one common passage
    rows += [(700, "same " * 100), (701, "same " * 50), (702, "same " * 12), (700, "same " * 13), (703, None), (704, ""), (705, " \n ")]
    rows += [(None, passages[4]), (None, "only here " * 8), (800, run(5000) + " " + passages[0] + " " + run(5000))]
    rows += [(3, rows[3][1] + " " + passages[1]), (-5, passages[2])]
    return rows


def test_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, n_words string").repartition(5)
    want = brute(rows)
    for more in ({}, {"spread": 3, "shard": 50}, {"filter_bits": 8, "shard": 50, "spread": 3}):
        assert sorted(map(tuple, s.substring_dedup(docs, **more).collect()), key=repr) == want
    assert s.substring_dedup(docs.limit(0)).count() == 0
    assert s.substring_dedup(docs.filter("doc_id = 702")).collect()[0].n_removed == 0


def signs(n):
    """Two words of 2^n signs whose polynomials agree modulo 2^64 at every odd place."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_of_equal_hash(spark):
    a, b = signs(10)
    words = lambda x: " ".join(f"{x}{k}" for k in range(13))
    rows = [(1, words(a)), (2, words(b)), (3, words(a) + " x")]
    got = {r.doc_id: r.n_removed for r in s.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_passages_are_found_by_words():
    import numpy as np
    import pyarrow as pa

    # one group whose rows share a hash but no window: nothing is found
    text = [" ".join(f"{c}{k}" for k in range(14)) for c in "xyx"]
    at, off, n, second = s.locate(np.zeros(3, int), np.zeros(3, bool), np.array([1, 2, 3]), np.zeros(3, bool), pa.array(text), 13)
    assert (at.tolist(), off.tolist(), n.tolist(), second) == ([2], [0], [14], [])


def test_oracle(spark, sf):
    oracle.same(s.op5_substring_dedup(spark, sf), s.ORACLES["op5_substring_dedup"], oracle.connect(sf))

import hashlib
import random
import re

import numpy as np
import oracle
from quillspark.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, bench, window=10):
    low = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    strings = []
    for item, t in bench:
        w = low(t)
        m = min(window, len(w))
        strings += [(str(item), w[k : k + m]) for k in range(len(w) - m + 1) if m]
    out = []
    for name, t in docs:
        w, hit, items = low(t), set(), set()
        for item, s in strings:
            for k in range(len(w) - len(s) + 1):
                if w[k : k + len(s)] == s:
                    hit.update(range(k, k + len(s)))
                    items.add(item)
        items = sorted(items)
        out.append((name, len(w), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit)))
    return out


BENCH = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (10, "two three four five six seven eight nine ten eleven"),
    (2, "Short item"),
    (3, "!!!"),
    (4, None),
    (5, "a a a a a a a a a a a a"),
    (6, "ünï"),
    (2, "another row"),
]
DOCS = [
    (1, "x one TWO three-four five;six seven eight nine ten. eleven y"),
    (2, "short item short short-item"),
    (3, None),
    (4, ""),
    (5, "a " * 2000),
    (6, "ünï Ünï one two"),
    (6, "ünï Ünï one two"),
    (None, "another row"),
    (8, "three four five six seven eight nine ten eleven twelve " * 300),
    (9, "one two three four five six seven eight nine"),
]


def test_brute_force(spark):
    docs = spark.createDataFrame([(*r, "z", 1) for r in DOCS], "doc_id long, text string, items string, n_hit int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for most in (1 << 20, 60):
        got = d.decontaminate(docs, bench, set_bytes=most).drop("items").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(brute(DOCS, BENCH), key=repr)
    assert d.decontaminate(docs.limit(0), bench).count() == 0
    assert d.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_rows_without_passages(spark):
    """Rows pass with all their columns, also where ids repeat or are null; in one set or several."""
    docs = spark.createDataFrame([(*r, "z", [1, None]) for r in DOCS], "doc_id long, text string, items string, more array<int>")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    want = sorted(((*r, "z", [1, None]) for r, b in zip(DOCS, brute(DOCS, BENCH)) if not b[5]), key=repr)
    for most in (1 << 20, 60):
        out = d.uncontaminated(docs, bench, set_bytes=most)
        assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=repr) == want
    assert d.uncontaminated(docs.limit(0), bench).count() == 0
    assert d.uncontaminated(docs, bench.limit(0)).count() == len(DOCS)


def test_words_of_equal_hash(spark):
    a, b = "a", "b"
    for _ in range(10):  # polynomials over their signs agree modulo 2^64 at every odd place
        a, b = a + b, b + a
    rows = [(k, " ".join(f"{x}{i}" for i in range(12))) for k, x in enumerate([a, b])]
    got = d.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows[:1], "item_id long, text string")).collect()
    assert {r.doc_id: r.n_hit for r in got} == {0: 12, 1: 0}


def test_strings_that_share_all_hashes_stay_apart(monkeypatch):
    """At place 0 all words of one length agree: buckets, first blocks and whole strings do; only the words tell them apart."""
    monkeypatch.setattr(d, "draw", lambda: 0)
    place, (table,) = d.compile_tables(["aa bb", "cc dd", "aa bb", "aa dd"], [0, 1, 2, 3], 2)
    assert place == 0 and len(table.suffixes) == 1 and sorted(table.string(k) for k in range(len(table.first))) == [b"aa bb", b"aa dd", b"cc dd"]
    words, raw = d._words(["xx aa dd yy cc dd", "aa bb"], place)
    at, k = d.search(words, raw, table)
    assert [(a, table.string(x)) for a, x in sorted(zip(at.tolist(), k.tolist()))] == [(1, b"aa dd"), (4, b"cc dd"), (6, b"aa bb")]
    assert [sorted(table.items[table.at[x] : table.at[x + 1]].tolist()) for _, x in sorted(zip(at.tolist(), k.tolist()))] == [[3], [1], [0, 2]]


def test_buckets_hold_several_strings():
    """Test strings that end alike share a bucket; a place is compared with those that begin alike too."""
    bench = [f"start off {w} of the" for w in ("one", "two", "three")] + ["other way one of the", "no such way end here"]
    _, (table,) = d.compile_tables(bench, list(range(5)), 5)
    assert len(table.suffixes) == 2 and len(table.first) == 5 and len(np.unique(table.places)) == 3
    rng = random.Random(1)
    vocabulary = ["start off", "one", "two", "three", "of the", "no", "such", "end", "here"]
    texts = [" ".join([" ".join(rng.choices(vocabulary, k=60)), rng.choice(bench)]) for _ in range(200)]
    place, (table,) = d.compile_tables(bench, list(range(5)), 5)
    words, raw = d._words(texts, place)
    at, k = d.search(words, raw, table)
    got = sorted((int(a), table.string(x).decode()) for a, x in zip(at, k))
    want, before = [], 0
    for t in texts:
        w = t.split()
        want += [(before + i, s) for i in range(len(w) - 4) for s in bench if w[i : i + 5] == s.split()]
        before += len(w)
    want.sort()
    assert got == want and len(got) >= 200


def test_oracle(spark, sf):
    oracle.same(d.op10_decontaminate(spark, sf), d.ORACLES["op10_decontaminate"], oracle.connect(sf))

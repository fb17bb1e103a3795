"""Phrase automata against plain searches."""

import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillspark.functions.packs import LATIN, ZH
from quillspark.functions.phrases import FEW, Book, Occurrences
from quillspark.functions.text import hits
from quillspark.operators import phrases as X


def test_counts_are_those_of_single_searches():
    rng = random.Random(1)
    for _ in range(300):
        signs = "aab漢é"
        own = ["".join(rng.choices(signs, k=rng.randint(0, 4))) for _ in range(rng.randint(0, 90))]
        text = "".join(rng.choices(signs, k=rng.randint(0, 60)))
        book = Book(own)
        want = {p: text.count(p) for p in own if p and p in text}
        assert {book.phrases[k]: n for k, n in book.counts(text).items()} == want
        assert book.present(text) == len(want)
        assert Occurrences(own).total(text) == sum(text.count(p) for p in own if p)
    assert Book([]).counts("a") == {} == Book(["", "a"]).counts(None)


def test_ten_thousand_phrases_cost_little_more_than_fifty():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(300)]
    many = [" ".join(rng.choices(words, k=2)) for _ in range(10_000)]
    took = []
    for own in (many[:50], many):
        book = Occurrences(own)
        best = 1e9
        for _ in range(3):
            t = time.perf_counter()
            for x in texts:
                book.total(x)
            best = min(best, time.perf_counter() - t)
        took.append(best)
    # the aim is twice; the machine may be busy
    assert took[1] < 4 * took[0], took


@pytest.mark.parametrize("most", [1000, 7])
def test_lexicons_over_texts(spark, most):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choices("ab cd", k=n))
    texts = [(k, make(40), "x") for k in range(30)] + [(30, None, "x"), (31, "", "x"), (0, "ab ab", "x")]
    own = [("one", "high", make(2)) for _ in range(20)] + [("two", "low", make(3)) for _ in range(20)] + [("two", "low", ""), ("two", "low", None), ("one", "high", "ab"), ("three", "low", "ab")]
    rows = spark.createDataFrame(texts, "id long, text string, phrase string")
    lexicon = spark.createDataFrame(own, "lexicon string, level string, phrase string")
    want = sorted((i, p, t.count(p)) for i, t, _ in texts if t for p in {x[2] for x in own} if p and p in t)
    assert sorted(tuple(r) for r in X.counted(rows, ["id"], lexicon, most=most).collect()) == want
    assert "Exchange" not in X.counted(rows, ["id"], lexicon)._jdf.queryExecution().executedPlan().toString()
    unique = rows.filter("text <> 'ab ab'")
    got = {(r.id, r.lexicon, r.level): (r.n, r.hits, r.density) for r in X.densities(unique, ["id"], lexicon, most=most).collect()}
    for i, t, _ in texts[:30]:
        for key in {x[:2] for x in own}:
            found = {p: t.count(p) for *k, p in own if tuple(k) == key and p and p in t}
            assert got.get((i, *key), (0, 0, 0.0)) == (sum(found.values()), len(found), pytest.approx(1000 * sum(found.values()) / len(t)))


def test_empty_lexicon(spark):
    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    none = spark.createDataFrame([], "lexicon string, level string, phrase string")
    assert X.counted(rows, ["id"], none).count() == 0 == X.densities(rows, ["id"], none).count()


def test_wide_packs_count_alike(spark):
    """A pack of many expressions goes by the automaton, with the same results."""
    from quillspark.operators import parse as P
    from quillspark.operators import sentences as T

    more = {k: v + [f"ganz eigen {k} {i}" for i in range(FEW)] for k, v in LATIN.connectors.items()}
    wide = replace(LATIN, connectors=more, slop={k: v + [f"leer {k} {i}" for i in range(FEW)] for k, v in LATIN.slop.items()})
    docs = spark.createDataFrame([(1, "Therefore it should be noted that this is so. Therefore, however, it plays a crucial role because of that.\nIn conclusion nothing was said, but then more.")], "doc_id long, text string")
    rows = [T.zones_raw(P.paragraphs(docs, p), p).orderBy("p_idx", "s_idx").collect() for p in (LATIN, wide)]
    assert rows[0] == rows[1] and any("connector" in r.signals for r in rows[0])
    few, many = (spark.createDataFrame([("a b c",), (None,)], "t string").select(hits(F.col("t"), own).alias("n")).collect() for own in (["a", "c", "x", "a"], ["a", "c", *(f"x{k}" for k in range(FEW))]))
    assert [r.n for r in few] == [r.n for r in many] == [2, 0]
    assert len(ZH.all_connectors) < FEW

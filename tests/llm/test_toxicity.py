import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import toxicity as t
from quillspark.llm._shared import text_bytes
from quillspark.llm._words import LOWER, NOT_ALNUM, Words


def words_of(texts):
    raw, at = text_bytes(pa.array(texts, pa.string()))
    return Words(LOWER[raw], at, NOT_ALNUM)


def plain_model(texts, labels, weigh):
    """Probabilities p(class, word, before) of the models, straight from the texts; None stands for any other word. weigh: evidence by counts, expected share and kinds."""
    from collections import Counter, defaultdict

    have, two, begun = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for x, y in dict.fromkeys(zip(texts, labels)):
        w = x.split()
        pairs = set(zip(["<", *w], w))
        have[y].update(set(w))
        two[y].update(pairs)
        begun[y].update(a for a, _ in pairs)
    vocab = sorted(have[0] | have[1])
    share = sum(have[1].values()) / (sum(have[0].values()) + sum(have[1].values()))
    wt = {w: weigh(have[0][w], have[1][w], share, len(vocab)) for w in vocab}
    expected = {w: wt[w] * have[1][w] / (have[0][w] + have[1][w]) + (1 - wt[w]) * share for w in vocab}
    kinds = len(two[0] | two[1])
    pt = {k: weigh(two[0][k], two[1][k], min(max(expected[k[1]], 1e-3 * share), 1 - 1e-3 * (1 - share)), kinds) for k in two[0] | two[1]}
    total = sum(have[0].values()) + sum(have[1].values())
    shared = {w: (have[0][w] + have[1][w] + 1) / (total + len(vocab) + 1) for w in vocab} | {None: 1 / (total + len(vocab) + 1)}
    after = [defaultdict(set), defaultdict(set)]
    for c in (0, 1):
        for a, b in two[c]:
            after[c][b].add(a)

    def p(c, word, before=None):
        n = {w: len(after[c][w]) for w in vocab}
        every = sum(n.values()) + 0.75
        untold = sum((1 - wt[w]) * n[w] for w in vocab) / every
        given = (sum(wt[w] * min(0.75, n[w]) for w in vocab) + 0.75) / every
        rest = sum((1 - wt.get(w, 0)) * shared[w] for w in shared)
        own, e = n.get(word, 0), wt.get(word, 0)
        one = e * max(own - 0.75, 0) / every + untold * (1 - e) * shared[word] / rest + given * shared[word]
        of = {b: pt[a, b] * max(k - 0.75, 0) / begun[c][before] for (a, b), k in two[c].items() if a == before}
        return of.get(word, 0) + (1 - sum(of.values())) * one

    return vocab, p


def test_model_against_plain_counts(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(260):
        words = rng.choices(base, k=rng.randint(1, 12))
        toxic = int(k % 3 == 0)
        words[rng.randrange(len(words)) :] = rng.choice([["oaf"], ["mild", "storm"], ["oaf", "oaf", "w1"]] if toxic else [["w1"], ["storm", "mild"], ["storm", "w2", "mild"]]) + words[-1:]
        rows.append((k, " ".join(words), toxic))
    rows += [(1000 + k, x, y) for k, (_, x, y) in enumerate(rows[:40])]  # copies count once
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    scorer = t.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    learnt = [(x, y) for k, x, y in rows if zlib.crc32(str(k).encode()) % 3 != 1]

    def weigh(a, b, share, kinds):
        from math import exp, lgamma, log

        odds = lgamma(a + 1) + lgamma(b + 1) - lgamma(a + b + 2) - b * log(share) - a * log(1 - share) - log(kinds)
        e = 1 / (1 + exp(-odds))
        return e if e > t.NEGLIGIBLE and a + b else 0.0

    vocab, p = plain_model([x for x, _ in learnt], [y for _, y in learnt], weigh)
    for c in (0, 1):
        for before in (None, "<", "storm", "oaf", "w1", "w7"):
            assert abs(sum(p(c, w, before) for w in [*vocab, None]) - 1) < 1e-9
    assert len(scorer.model.pairs) and len(scorer.model.hashes)
    for text in ["oaf", "mild storm w4 oaf oaf w1", "storm mild storm w2 w9", "w3 strange oaf w1", "strange"]:
        w = text.split()
        known = lambda x: x if x in vocab else None
        want = sum(np.log(p(1, known(b), a) / p(0, known(b), a)) for a, b in zip(["<", *w], w)) / len(w)
        assert abs(scorer.model.ratio(words_of([text]))[0] - want) < 1e-7, text
    base = np.log(p(1, None) / p(0, None))
    assert np.allclose(scorer.model.ratio(words_of(["", None])), base)


def test_evidence():
    from math import lgamma, log

    counts = np.array([[0.0, 5, 900, 90, 0], [0, 0, 100, 60, 9]])
    got = t.evidence(counts, 0.1, 1000)
    for k, (a, b) in enumerate(counts.T):
        odds = lgamma(a + 1) + lgamma(b + 1) - lgamma(a + b + 2) - b * log(0.1) - a * log(0.9) - log(1000)
        assert abs(got[k] - (1 / (1 + np.exp(-odds)) if a + b else 0)) < 1e-7
    assert got[2] < 0.01 and got[3] > 0.99 and got[4] > 0.99


@pytest.mark.parametrize("lang", ["en", "de", "es", "fr"])
def test_held_out_area_by_language(held, lang):
    assert area([r for r in held if r.lang == lang]) >= 0.9


def test_held_out_area(held):
    assert area(held) >= 0.9


def area(rows):
    good, bad = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    order = np.sort(bad)
    return float(np.mean((np.searchsorted(order, good) + np.searchsorted(order, good, "right")) / 2 / len(bad)))


@pytest.fixture(scope="module")
def held(spark):
    sf = "/root/testdata/sf0.1"
    found = t.op7_toxicity(spark, sf).filter("held_out")
    return found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()


def corpus(n=600):
    rng = random.Random(3)
    base, bad = [f"w{k}" for k in range(400)], ["oaf", "twit", "dolt"]
    docs, labels = [], []
    for k in range(n):
        words = rng.choices(base, k=rng.randint(5, 60))
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((k, " ".join(words), "q"))
        labels.append((k, int(toxic)))
    return docs, labels


def test_held_out_rows_and_edges(spark):
    docs, labels = corpus()
    odd = [(1001, None, "q"), (1002, "", "q"), (1003, "oaf " * 30_000, "q"), (1003, "oaf " * 30_000, "q"), (None, "w1 twit dolt oaf", "q"), (1004, "!!", "q")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (5, None), (None, 1), (7, 3)], "doc_id long, toxic int")
    rows = t.toxicity(df, lab).collect()
    assert len(rows) == len(docs) + len(odd)
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    by = {r.doc_id: r for r in rows}
    assert by[1003].predicted == 1 and by[None].predicted == 1
    assert by[1001].score == by[1002].score == by[1004].score and by[1001].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert t.toxicity(df.limit(0), lab).count() == 0
    assert {r.score for r in t.toxicity(df, lab.limit(0)).collect()} == {0.0}


def test_a_model_met_by_joins_scores_alike(spark):
    docs, labels = corpus(400)
    odd = [(1001, None, "q"), (1002, "", "q"), (1003, "oaf " * 3000, "q"), (1003, "oaf " * 3000, "q"), (None, "w1 twit dolt oaf", "q"), (1004, "!!", "q")]
    docs += [(2000 + k, "mild storm over w1" if k % 2 else "storm mild w2 w3", "q") for k in range(60)]
    labels += [(2000 + k, k % 2) for k in range(60)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, score string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    one, two = (sorted(map(tuple, t.toxicity(df, lab, most=most).collect()), key=lambda r: (r[0] is None, r[0])) for most in (10**6, 0))
    assert len(one) == len(two) == len(docs) + len(odd) and len({r[2] for r in one}) > 50
    for a, b in zip(one, two):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 and a[3] == b[3]


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = corpus(200)
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = lab.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(t.toxicity(df, lab).collect()) == sorted(t.toxicity(df, flipped).collect())


def test_curve_rises():
    x = np.array([0.0, 0.1, 0.2, 1.0, 1.1])
    a, b = t.curve(x, np.array([0, 0, 0, 1, 1]))
    assert a > 0 and 1 / (1 + np.exp(-(a * 1.1 + b))) > 0.6 > 1 / (1 + np.exp(-b))


def test_rare_words_of_a_large_vocabulary_are_learnt(spark):
    # 140000 ordinary words, each in more texts than the one that tells
    rng, base, docs = random.Random(5), [f"w{k}" for k in range(140_000)], []
    for k in range(30):
        rng.shuffle(base)
        docs.append((k, " ".join(base), 0))
    docs += [(100 + k, f"oaf t{k}", 1) for k in range(18)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    scorer = t.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert t.find(scorer.model.hashes, words_of(["oaf"]).hash)[0] >= 0
    assert scorer.scores(words_of(["oaf oaf"]))[0] > 0.5 > scorer.scores(words_of(["w1 w2 w3"]))[0]


def test_curve_has_rows_of_a_rare_class(spark, monkeypatch):
    monkeypatch.setattr(t, "CURVE_ROWS", 8)
    docs = [(k, f"the red w{k % 97} house w{k % 89} stood", int(k % 200 == 0)) for k in range(8000)]
    docs = [(k, text + " oaf twit dolt" * toxic, toxic) for k, text, toxic in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    scorer = t.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert scorer.model is not None
    got = scorer.scores(words_of(["the oaf twit dolt", "the red house stood"]))
    assert got[0] > 0.5 > got[1]


def test_toxic_rows_of_one_fold_alone(spark):
    fold = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 2][:40]
    docs = [(k, f"the red w{k % 97} house" + " oaf twit dolt" * (k in fold), int(k in fold)) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    got = t.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic")).scores(words_of(["the oaf twit dolt", "the red house"]))
    assert got[0] > 0.5 > got[1]


def test_weights_stand_for_rows():
    x, y = np.array([0.0, 0.2, 0.4, 0.3, 1.0]), np.array([0, 0, 0, 1, 1])
    a, b = t.curve(x, y, np.array([1000.0] * 3 + [1.0] * 2))
    assert a > 0 and 1 / (1 + np.exp(-(a * 0.3 + b))) < 0.5

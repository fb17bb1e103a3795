import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import language_id as g


def plain(text):
    p = [ord(c.lower()) if c.isalpha() else 32 for c in text]
    p = [32, *p, 32]
    out = Counter()
    for n in g.SIZES:
        for k in range(len(p) - n + 1):
            x = p[k : k + n]
            if n == 1 and x[0] == 32 or n == 2 and x == [32, 32] or n == 3 and x[1] == 32:
                continue
            h = 0
            for j, c in enumerate(x):
                h = (h ^ c) * int(g._MULTIPLY[j]) & 0xFFFFFFFF
                h ^= h >> 15
            out[h >> 32 - g.BITS] += 1
    return out


def test_grams_by_pieces(monkeypatch):
    text = "Straße, über  Ärger!\n x1y 漢字 \U0001d400 ÉÉ " * 5
    for step in (1 << 20, 7, 3):
        monkeypatch.setattr(g, "STEP", step)
        for t in (text, "", "a", "ab", "..", "abc", "abcdefg", "abcdefgh"):
            got = g.grams(g.letters(np.frombuffer(t.encode(), np.uint8)))
            assert {k: int(n) for k, n in enumerate(got) if n} == dict(plain(t)), (step, t)


def test_model_against_loops(spark):
    """The vectors, centroids' radii and predictions of a learnt model, worked out with loops over plain counts."""
    rng = random.Random(5)
    make = lambda s: " ".join("".join(rng.choices(s, k=rng.randint(2, 6))) for _ in range(12))
    rows = [(k, make(("abcd", "abxy", "mnop")[k % 3]), ("aa", "ab", "mm")[k % 3]) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = g.fit(docs)
    learnt = [(t, lang) for k, t, lang in rows if zlib.crc32(str(k).encode()) % 5 != 0]
    counts = [plain(t) for t, _ in learnt]
    df = Counter(x for c in counts for x in c)
    idf = {x: math.log((1 + len(learnt)) / (1 + n)) + 1 for x, n in df.items()}
    rest = math.log(1 + len(learnt)) + 1

    def vector(c):
        v = {x: math.log1p(n) * idf.get(x, rest) for x, n in c.items()}
        norm = math.sqrt(sum(y * y for y in v.values()))
        return {x: y / norm for x, y in v.items()}

    cosine = lambda v, c: sum(y * float(c[x]) for x, y in v.items())
    vectors = [vector(c) for c in counts]
    assert m.languages == ["aa", "ab", "mm"] and np.allclose(np.linalg.norm(m.centroids, axis=1), 1, atol=1e-5)
    for k, lang in enumerate(m.languages):
        places = [j for j in range(len(m.owner)) if m.owner[j] == k]
        assert 1 <= len(places) <= g.CENTROIDS
        own = [v for v, (_, x) in zip(vectors, learnt) if x == lang]
        near = [max(places, key=lambda j: cosine(v, m.centroids[j])) for v in own]
        for j in places:
            mine = [v for v, n in zip(own, near) if n == j]
            mean = np.zeros(1 << g.BITS)
            for v in mine:
                for x, y in v.items():
                    mean[x] += y
            assert np.allclose(mean / np.linalg.norm(mean), m.centroids[j], atol=1e-4)  # clustering has settled
            assert abs(m.radius[j] - np.quantile([cosine(v, m.centroids[j]) for v in mine], g.BEYOND)) < 1e-5
    for r in g.language_id(docs, model=m).collect():
        text = rows[r.doc_id][1]
        best = max(range(len(m.owner)), key=lambda j: cosine(vector(plain(text)), m.centroids[j]))
        score = cosine(vector(plain(text)), m.centroids[best])
        assert r.lang_pred == m.languages[m.owner[best]] and abs(r.score - score) < 1e-5
        assert r.rejected == (score < m.radius[best]) or abs(score - m.radius[best]) < 1e-5


def test_sample_has_a_bound(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('wort ', id) as text", "if(id % 2 = 0, 'aa', 'bb') as lang")
    asked = []
    real, g.weigh = g.weigh, lambda counts, idf: asked.append(len(counts)) or real(counts, idf)
    try:
        g.fit(docs, per_language=50, in_all=80)
    finally:
        g.weigh = real
    assert 30 < asked[0] < 140


def test_held_out_accuracy(spark, sf):
    rows = g.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) > 100
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in held) < 0.1 * len(held)


def test_edges_and_labels_of_held_out_rows(spark):
    rng = random.Random(1)
    make = lambda s: " ".join("".join(rng.choices(s, k=rng.randint(2, 8))) for _ in range(30))
    rows = [(k, make("abcde" if k % 2 else "vwxyz"), "aa" if k % 2 else "zz") for k in range(200)]
    odd = [(500, None, "aa"), (501, "", None), (502, "123 !?", "zz"), (503, "vwx yz " * 50_000, None), (None, "abc cab", None), (503, "xyz", None), (504, "漢字仮名", None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = g.language_id(docs).collect()
    assert len(got) == 207
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == ("aa" if k % 2 else "zz") for k in range(200))
    assert [(by[k].lang_pred, by[k].score) for k in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[503].lang_pred == "zz" and by[None].lang_pred == "aa" and not by[None].held_out
    assert by[504].rejected
    wrong = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, "qq").otherwise(F.col("lang")))
    assert sorted(map(str, g.language_id(wrong).collect())) == sorted(map(str, got))
    assert {r.lang_pred for r in g.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert g.language_id(docs.limit(0)).count() == 0


def test_a_language_of_one_repeated_id_is_learnt(spark):
    rng = random.Random(8)
    make = lambda s: " ".join("".join(rng.choices(s, k=rng.randint(2, 6))) for _ in range(15))
    rows = [(1, make("abcdefgh"), "en") for _ in range(3000)] + [(2, make("mnopqrst"), "de") for _ in range(3000)]
    rows += [(3, rows[0][1], "en")] * 3000  # and copies of one text don't crowd the sample
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = g.fit(docs, per_language=200)
    assert m.languages == ["de", "en"]
    got = g.language_id(docs, model=m).groupBy("doc_id", "lang_pred").count().collect()
    assert {(r.doc_id, r.lang_pred): r["count"] for r in got} == {(1, "en"): 3000, (2, "de"): 3000, (3, "en"): 3000}


def test_the_sample_is_bounded(spark, monkeypatch):
    seen = []
    whole = g.weigh
    monkeypatch.setattr(g, "weigh", lambda counts, idf: seen.append(len(counts)) or whole(counts, idf))
    rows = [(k, f"word{k} some text of its own {k}", f"l{k % 3}") for k in range(900)]
    g.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert seen[0] == 150
    g.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50, in_all=30)
    assert seen[-1] == 30

"""Fingerprints against plain sets, and the order of documents against a plain loop."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import fingerprints as D

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def ordered(rows):
    """(id, text, edited, next text)"""
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), sha(r[1])))
    nexts = [*rows[1:], *rows[:1]]
    return [(i, t, t[: len(t) - len(t) // 3] + n[: len(t) // 3], n) for (i, t), (_, n) in zip(rows, nexts, strict=True)]


def slow_print(text, bins=D.BINS, bits=D.BITS):
    """A fingerprint one shingle and one bin at a time."""
    import pyarrow as pa

    w = words(text)
    if not w:
        return ""
    best = {}
    for s in shingles(text):
        raw, at = D.text_bytes(pa.array([" ".join(s)], pa.large_string()))
        (h,) = (int(x) for x in D.shingle_hashes(D.Words(raw, at, D.WHITE), 5)[0])
        best[h >> (64 - 9)] = min(best.get(h >> (64 - 9), 1 << 64), h & ((1 << 55) - 1))
    seek = D.orders(bins)
    low = [next(best[j] for j in [b, *seek[:, b].tolist()] if j in best) % (1 << bits) for b in range(bins)]
    return "".join(f"{x:x}" for x in low)


def check(got, rows):
    want = sorted((i if i is not None else -1, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in ordered(rows))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in got) == want


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = D.op13_fingerprints(spark, SF).collect()
    check(got, rows)
    by, off = {r.doc_id: r for r in got}, []
    for i, t, e, n in ordered(rows):
        r = by[i]
        assert r.fingerprint and len(r.fingerprint) == D.BINS * D.BITS // 4
        off += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, n)]
    off = np.array(off)
    assert abs(off).mean() < 0.02 and abs(off).max() < 0.15, (abs(off).mean(), abs(off).max())
    for i, t, *_ in ordered(rows)[::20]:
        assert by[i].fingerprint == slow_print(t)
    same = {}
    for i, t in rows:
        assert same.setdefault(t, by[i].fingerprint) == by[i].fingerprint


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_edges(spark, ranges):
    rows = [(5, None), (9, ""), (3, "one two three"), (3, "one two three"), (7, "ein wort " * 400), (None, "äöü 漢字 " * 9), (4, "A b\tC\x0bd e f"), (-2, "x"), (4, " \n"), (2**62, "y" * 50000), (1, "🙂" * 10)]
    rows += [(8, "the same text again and again")] * 30
    docs = spark.createDataFrame([(*r, 0, "a", "b") for r in rows], "doc_id long, text string, place int, kind string, salt string")
    got = D.compared_with_next(docs, ranges=ranges).collect()
    check(got, rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert sorted(r.near_next for r in got if r.doc_id == 8)[1:] == [1.0] * 29
    assert all(r.fingerprint == "" and r.near_edited == 1 for r in got if r.doc_id == 9)
    for r in (r for r in got if r.doc_id == 3):
        assert r.fingerprint == slow_print("one two three")


@pytest.mark.parametrize("rows", [[], [(1, "a b c d e f")], [(1, None)], [(1, "abc"), (1, "abc")]])
def test_small_tables(spark, rows):
    got = D.compared_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(got, rows)


def test_likeness_follows_jaccard(spark):
    """Over the whole range of similarities and of lengths, without bias."""
    rng = np.random.default_rng(4)
    rows, want = [], []
    for n in (8, 40, 200, 1500):
        for share in np.linspace(0, 1, 41):
            a = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
            b = a[: int(n * share)] + [f"w{x}" for x in rng.integers(0, 1 << 40, n - int(n * share))]
            rows.append((len(rows), n, " ".join(a), " ".join(b)))
            want.append(jaccard(rows[-1][2], rows[-1][3]))
    df = spark.createDataFrame(rows, "k int, n int, a string, b string").select("k", "n", D.likeness(D.fingerprint(F.col("a")), D.fingerprint(F.col("b"))).alias("x"))
    off = {}
    for r in df.collect():
        off.setdefault(r.n, []).append(r.x - want[r.k])
    for n, x in off.items():
        # as many bins as shingles at most tell them apart
        spread = math.sqrt(0.3 / min(n, D.BINS)) + 0.02
        assert abs(np.mean(x)) < spread / 3 and np.abs(x).max() < 4 * spread, (n, np.mean(x), np.abs(x).max())


@pytest.mark.parametrize("bins, bits", [(8, 1), (64, 2), (256, 8)])
def test_other_sizes(spark, bins, bits):
    df = spark.createDataFrame([("a b c d e f g",), (None,)], "text string")
    rows = df.select(D.fingerprint(F.col("text"), bins, bits).alias("f")).collect()
    assert len(rows[0].f) == bins * bits // 4 and rows[1].f == ""
    assert df.select(D.likeness(F.lit(rows[0].f), F.lit(rows[0].f), bits).alias("x")).first().x == 1
    with pytest.raises(ValueError):
        D.fingerprint(F.col("text"), 100)


def test_texts_cross_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = docs.select(D.fingerprint(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<text:string>" in plan

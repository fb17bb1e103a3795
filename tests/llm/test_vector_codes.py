"""Vector codes against SQL and against a plain reckoning with Python's integers."""

import hashlib
import math

import numpy as np
import oracle
import pytest

from quillspark.llm import vector_codes as V

SF = "/root/testdata/sf0.001"


def plain(rows, scale=V.SCALE, parts=V.PARTS, entries=V.ENTRIES, rounds=V.ROUNDS):
    """id, label, code, error, label_error, digest of vectors of one length."""
    kept = [(i, [math.floor(x * scale) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    if not kept:
        return []
    n = len(kept[0][1])
    cut = lambda v, p: v[p * n // parts : (p + 1) * n // parts]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        at = [[best(v, p) for p in range(parts)] for _, v, _ in kept]
        new = []
        for p in range(parts):
            own = lambda e: [cut(v, p) for (_, v, _), a in zip(kept, at, strict=True) if a[p] == e]  # noqa: B023, E731
            new.append([[sum(c) // len(o) for c in zip(*o, strict=True)] if (o := own(e)) else old for e, old in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        a = [best(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{x:02x}" for x in a), sum(far(cut(v, p), books[p][a[p]]) for p in range(parts))))
    return [(*r, sum(o[3] for o in out if o[1] == r[1]), sha) for r in out]


def found(spark, rows, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return sorted((tuple(r) for r in V.compress(df, **how).collect()), key=repr)


def test_oracle(spark):
    oracle.same(V.op11_vector_codes(spark, SF), V.ORACLES["op11_vector_codes"], oracle.connect(SF))


def made(n, width=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, width)], int(i) % 3) for i in rng.permutation(n)]
    odd = [(1000, None, 0), (1001, [None, *[0.5] * (width - 1)], 0), (1002, [math.nan, *[0.5] * (width - 1)], 1), (1003, [math.inf] * width, 1), (1004, [-0.0] * width, None), (1005, [1e-9] * width, None)]
    return rows + odd + [(2000 + k, rows[2][1], 1) for k in range(40)]  # many copies of one vector


def test_brute_force(spark):
    rows = made(60)
    assert found(spark, rows) == sorted(plain(rows), key=repr)


def test_few_vectors_and_repeated_rows(spark):
    rows = made(4) + [(None, [0.25] * 16, 2)]
    again = rows + rows[:3]
    want = sorted(plain(again), key=repr)
    assert found(spark, again) == want
    assert len(want) == len([r for r in again if r[1] and None not in r[1] and all(map(math.isfinite, r[1]))])


def test_lengths_have_their_own_codebooks(spark):
    a, b = made(20, 16), [(i + 5000, v, x) for i, v, x in made(20, 11, 2)]
    got = found(spark, a + b)
    want = {w[0]: w for w in plain(a) + plain(b)}
    assert len(got) == len(want) and all(g[2:4] == want[g[0]][2:4] and g[5] == want[g[0]][5] for g in got)
    assert all(g[4] == sum(o[3] for o in got if o[1] == g[1]) for g in got)


@pytest.mark.parametrize("big", [3e5, 1e9, 1e13])
def test_large_components(spark, big):
    rows = [(k, [(-1) ** k * big * (k + 1), *[0.1 * k] * 15], k % 2) for k in range(30)]
    want = [(*r[:3], *(x if x < 1 << 63 else None for x in r[3:5]), r[5]) for r in plain(rows)]
    assert found(spark, rows, "double") == sorted(want, key=repr)


def test_empty_tables_and_vectors(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 0)]) == []
    ((_, _, code, error, label_error, sha),) = found(spark, [(1, [], 0)])
    assert (code, error, label_error, sha) == ("00" * V.PARTS, 0, 0, hashlib.sha256(b"").hexdigest())


def test_clashing_names(spark):
    rows = [(k, [0.1 * k] * 8, 0, "x") for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, parts array<double>, row int, length string")
    df = df.selectExpr("*", "length AS entry", "length AS part", "length AS error", "length AS code", "length AS id", "length AS label", "length AS vector")
    assert V.compress(df, vector_col="parts", label_col="row").count() == 5


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    for size in (10, 1 << 20, 1 << 40, 1 << 61):
        rows, entries = rng.integers(-size, size, (50, 8)), rng.integers(-size, size, (16, 8))
        entries[3] = entries[1]
        best, far = V.nearest(rows, entries.astype(object))
        for r, b, d in zip(rows.tolist(), best, far, strict=True):
            all_ = [sum((x - y) ** 2 for x, y in zip(r, e, strict=True)) for e in entries.tolist()]
            assert int(d) == min(all_) and b == all_.index(min(all_))

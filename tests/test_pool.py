"""The nearest of a pool, by cells and bounds, against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import semantic as V


def frames(spark, rows, pool):
    a = spark.createDataFrame([(k, None if v is None else [float(x) for x in v], "n") for k, v in rows], "id long, vec array<double>, row string")
    return a, spark.createDataFrame([(None if v is None else [float(x) for x in v],) for v in pool], "ref array<double>")


@pytest.mark.parametrize("kind", ["clustered", "lengths", "copies"])
def test_the_maximum_is_exact(spark, kind, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 40)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    pool = centres[rng.integers(0, 12, 900)] + 0.1 * rng.normal(size=(900, 16))
    rows = centres[rng.integers(0, 12, 200)] + 0.1 * rng.normal(size=(200, 16))
    if kind == "lengths":
        pool *= rng.uniform(0.1, 3, (900, 1))
    else:
        pool, rows = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (pool, rows))
    if kind == "copies":
        pool = np.concatenate([pool, np.repeat(pool[:1], 600, 0)])
        rows[:120] = pool[0]
    a, b = frames(spark, [*enumerate(rows), (5000, None), (7, rows[7])], [*pool, None])
    got = V.pool_similarity(a, b, ["id"], block=100).collect()
    want = (rows @ pool.T).max(1)
    assert len(got) == 202 and [r for r in got if r.id == 5000][0].similarity is None
    assert all(abs(r.similarity - want[r.id]) < 1e-12 for r in got if r.id != 5000)
    share = sum(r.compared for r in got if r.compared) / (201 * 900)
    print(kind, share)
    assert share < (0.5 if kind != "lengths" else 1.01)


def test_small_and_empty_pools(spark):
    a, b = frames(spark, [(1, [1, 0]), (2, [0, 2])], [[1, 1], [3, 0]])
    assert {r.id: (r.similarity, r.compared) for r in V.pool_similarity(a, b, ["id"]).collect()} == {1: (3.0, 2), 2: (2.0, 2)}
    assert [r.similarity for r in V.pool_similarity(a, b.filter(F.lit(False)), ["id"]).collect()] == [None, None]
    assert V.pool_similarity(a.filter(F.lit(False)), b, ["id"]).count() == 0


def test_tasks_hand_on_copies_in_pieces(spark, monkeypatch):
    """Rows that no bound keeps from any cell are copied for each; never more than a piece of them stands in a task at once."""
    monkeypatch.setattr(V, "HANDED", 50)
    monkeypatch.setattr(V, "SLICE", 30)
    rng = np.random.default_rng(2)
    pool, rows = rng.normal(size=(400, 24)), rng.normal(size=(90, 24))
    a, b = frames(spark, list(enumerate(rows)), list(pool))
    got = {r.id: r.similarity for r in V.pool_similarity(a, b, ["id"], block=100).collect()}
    want = (rows @ pool.T).max(1)
    assert len(got) == 90 and all(abs(got[k] - want[k]) < 1e-12 for k in got)

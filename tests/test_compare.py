"""Alignment of paragraphs before and after a rewrite."""

import itertools
import random

from quillspark.operators import compare as C


def test_known_edits():
    a = ["one two three four", "five six seven eight", "nine ten eleven twelve", "the end of it all"]
    assert C.align(a, a) == [(k, k) for k in range(4)]
    assert C.align(a, ["new", *a]) == [(k, k + 1) for k in range(4)]
    assert C.align(a, [*a[:2], "put in", *a[2:]]) == [(0, 0), (1, 1), (2, 3), (3, 4)]
    assert C.align(a, a[:1] + a[2:]) == [(0, 0), (2, 1), (3, 2)]
    assert C.align(a, [a[0], "five six seven nine", "quite other words", a[2], a[3]]) == [(0, 0), (1, 1), (2, 3), (3, 4)]
    assert C.align([], a) == [] == C.align(a, [])
    assert C.align(["x"] * 3, ["x"] * 5)[:3] == [(0, 0), (1, 1), (2, 2)]


def test_pairs_are_ordered_and_share_most():
    rng = random.Random(1)
    for _ in range(200):
        make = lambda: "".join(rng.choices("abcd", k=rng.randint(3, 7)))
        a = [make() for _ in range(rng.randint(0, 5))]
        b = [rng.choice(a) if a and rng.random() < 0.6 else make() for _ in range(rng.randint(0, 5))]
        got = C._between(a, b)
        share = lambda i, j: len(C._pairs(a[i]) & C._pairs(b[j])) / len(C._pairs(a[i]) | C._pairs(b[j]))  # noqa: B023, E731
        assert all(x < y and u < v for (x, u), (y, v) in itertools.pairwise(got)) and all(share(i, j) >= C.ALIKE for i, j in got)
        best = 0.0
        for n in range(1, min(len(a), len(b)) + 1):
            for i in itertools.combinations(range(len(a)), n):
                for j in itertools.combinations(range(len(b)), n):
                    parts = [share(x, y) for x, y in zip(i, j)]
                    if min(parts) >= C.ALIKE:
                        best = max(best, sum(parts))
        assert abs(sum(share(i, j) for i, j in got) - best) < 1e-9
        full = C.align(a, b)
        assert all(x < y and u < v for (x, u), (y, v) in itertools.pairwise(full))


def test_an_inserted_paragraph_moves_no_other(spark):
    a = [(1, 0, "alpha beta gamma delta", "red"), (1, 1, "epsilon zeta eta theta", "green"), (2, 0, "only before this one", "red"), (4, 0, "same as it was", "deep_red")]
    b = [(1, 0, "something else at first", "yellow"), (1, 1, "alpha beta gamma delta", "yellow"), (1, 2, "epsilon zeta eta theta", "green"), (3, 0, "only after this one", "green"), (4, 0, "same as it is", "red")]
    before = spark.createDataFrame(a, "doc_id long, p_idx int, text string, fused_level string")
    after = spark.createDataFrame(b, "doc_id long, p_idx int, text string, level string")
    got = {(r.doc_id, r.p_before, r.p_after): r.change for r in C.aligned(before, after).collect()}
    assert got == {(1, None, 0): "added", (1, 0, 1): "better", (1, 1, 2): "same", (2, 0, None): "removed", (3, None, 0): "added", (4, 0, 0): "better"}
    assert [r.change for r in C.compared(before, after).filter("doc_id = 1").orderBy("p_idx").collect()] != ["better", "same", "added"]


def test_documents_are_aligned_in_batches(spark):
    """Documents in one scan only and one without an id are there; no document is a call of its own."""
    rows = lambda own, level: spark.createDataFrame([(d, p, t, "red") for d, p, t in own], f"doc_id long, p_idx int, text string, {level} string")
    got = C.aligned(rows([(1, 0, "one of all"), (2, 0, "here only"), (None, 0, "no id")], "fused_level"), rows([(1, 0, "put in"), (1, 1, "one of all"), (3, 0, None), (None, 0, "no id")], "level"))
    assert set(map(tuple, got.select("doc_id", "p_before", "p_after", "change").collect())) == {(1, 0, 1, "same"), (1, None, 0, "added"), (2, 0, None, "removed"), (3, None, 0, "added"), (None, 0, 0, "same")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and plan.count("ArrowEvalPython [") == 1

"""Before and after: what a rewrite has changed."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _change(before: Column, after: Column) -> Column:
    rank = F.create_map(*(F.lit(x) for k, z in enumerate(("green", "yellow", "red", "deep_red")) for x in (z, k)))
    a, b = rank[before], rank[after]
    return F.when(a.isNull(), "added").when(b.isNull(), "removed").when(b < a, "better").when(b > a, "worse").otherwise("same")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, p_idx, level_before, level_after, change: a row per paragraph of either scan; before by its fused level, after by its rule level.

    before: doc_id, p_idx, fused_level; after: doc_id, p_idx, level. change is better, worse, same, added or removed.
    """
    rows = before.select("doc_id", "p_idx", F.col("fused_level").alias("level_before")).join(after.select("doc_id", "p_idx", F.col("level").alias("level_after")), ["doc_id", "p_idx"], "full")
    return rows.withColumn("change", _change(F.col("level_before"), F.col("level_after")))


def high_risk(rows: DataFrame) -> DataFrame:
    """One row: paragraphs of high risk before and after."""
    of = lambda c: F.count_if(F.col(c).isin("red", "deep_red"))
    return rows.agg(of("level_before").alias("high_risk_before"), of("level_after").alias("high_risk_after"))

#: How much of their pairs of signs two paragraphs must share to be one that was rewritten.
ALIKE = 0.5


def _pairs(text: str) -> set[str]:
    bare = "".join(text.split())
    return {bare[k : k + 2] for k in range(len(bare) - 1)} or {bare}


def _between(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The pairs (i, j), in order in both, that share most in all; only pairs that share at least ALIKE."""
    left, right = [_pairs(t) for t in a], [_pairs(t) for t in b]
    gain = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    like: dict[tuple[int, int], float] = {}
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            same = len(left[i] & right[j])
            share = same / (len(left[i]) + len(right[j]) - same)
            best = max(gain[i + 1][j], gain[i][j + 1])
            if share >= ALIKE and share + gain[i + 1][j + 1] > best:
                like[i, j] = best = share + gain[i + 1][j + 1]
            gain[i][j] = best
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if (i, j) in like and like[i, j] == gain[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif gain[i + 1][j] >= gain[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Which paragraphs of b are those of a, as pairs of places in order: equal ones at both ends, then the longest ordered row of those that stand once in each, then what is alike between them.

    The work grows with the square of the changed paragraphs between two that stayed the same.
    """
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    end = 0
    while end < min(len(a), len(b)) - n and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[n : len(a) - end], b[n : len(b) - end]
    once = {t for t, c in Counter(x).items() if c == 1} & {t for t, c in Counter(y).items() if c == 1}
    at = {t: j for j, t in enumerate(y) if t in once}
    # the longest row of places that rise in both
    tails: list[int] = []
    ends: list[tuple[int, int]] = []
    back: dict[tuple[int, int], tuple[int, int] | None] = {}
    for i, t in enumerate(x):
        if t in once:
            k = bisect_left(tails, at[t])
            back[i, at[t]] = ends[k - 1] if k else None
            tails[k : k + 1], ends[k : k + 1] = [at[t]], [(i, at[t])]
    row, p = [], ends[-1] if ends else None
    while p:
        row.append(p)
        p = back[p]
    pairs, i0, j0 = [], 0, 0
    for i, j in [*reversed(row), (len(x), len(y))]:
        pairs += [(i0 + u, j0 + v) for u, v in _between(x[i0:i], y[j0:j])]
        if i < len(x):
            pairs.append((i, j))
        i0, j0 = i + 1, j + 1
    return [*((k, k) for k in range(n)), *((n + i, n + j) for i, j in pairs), *((len(a) - k, len(b) - k) for k in range(end, 0, -1))]


def aligned(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, p_before, p_after, level_before, level_after, change: as compared(), but paragraphs meet by what they say and not by their number, so that one more or less moves no other.

    before: doc_id, p_idx, text, fused_level; after: doc_id, p_idx, text, level. A document that is in one of the two only has all its paragraphs removed or added. A document's paragraphs meet in one task.
    """

    def run(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        found = []
        for left, right in zip(lefts.to_pylist(), rights.to_pylist()):
            x, y = left or [], right or []
            pairs = align([r["text"] or "" for r in x], [r["text"] or "" for r in y])
            met, there = {i for i, _ in pairs}, {j for _, j in pairs}
            rows = [*pairs, *((i, None) for i in range(len(x)) if i not in met), *((None, j) for j in range(len(y)) if j not in there)]
            found.append([{"i": i, "j": j} for i, j in rows])
        return pa.array(found, pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))

    # each side's paragraphs of a document as one array in order, so that documents go over in batches and not one by one
    whole = lambda df, level: df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p_idx", "text", level))).alias(level))
    a, b = whole(before, "fused_level"), whole(after, "level").withColumnRenamed("doc_id", "_id")
    both = a.join(b, F.col("doc_id").eqNullSafe(F.col("_id")), "full").withColumn("doc_id", F.coalesce("doc_id", "_id"))
    # the outer form, as the engine's filter for the other one would align all a second time; every document has a row
    each = both.withColumn("_m", F.explode_outer(F.arrow_udf(run, "array<struct<i: int, j: int>>")(F.transform("fused_level", lambda r: F.struct(r.text.alias("text"))), F.transform("level", lambda r: F.struct(r.text.alias("text"))))))
    a, b = F.get("fused_level", F.col("_m.i")), F.get("level", F.col("_m.j"))
    rows = each.select("doc_id", a.p_idx.cast("int").alias("p_before"), b.p_idx.cast("int").alias("p_after"), a.fused_level.alias("level_before"), b.level.alias("level_after"))
    return rows.select("doc_id", "p_before", "p_after", "level_before", "level_after", _change(F.col("level_before"), F.col("level_after")).alias("change"))

"""Connected components by turns of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import unwrite, written


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m) with the least of u and its neighbours. The key has an exchange of its own, so a hub's can be split."""
    keyed = F.xxhash64("u").alias("key")
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.select("*", keyed).join(least.select("*", keyed), ["key", "u"])


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """From links (u, v), a row (u, v) for each node u but the least of its component, which is v. rows: how many links there are, about."""
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", rows)
    before = _sum(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        new = written(small, "links", before[0])
        after = _sum(new)
        unwrite(edges)
        edges = new
        if after == before:
            break
        before = after
    return edges

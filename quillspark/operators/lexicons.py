"""Words of a language without spaces, and how often they stand in texts, learnt from the texts themselves."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.segment import Segmenter
from ..sources.stored import stored

#: Signs of a word at most, occurrences at least, and words that a task holds at most.
LONGEST, LEAST, MOST = 4, 5, 1_000_000
#: How much more often than by chance a word's parts must stand together, and the bits by which its neighbours on either side must differ.
COHESION, FREEDOM = 8.0, 1.0


def _runs(texts: DataFrame, text_col: str) -> DataFrame:
    """run, n: the Chinese runs of all texts, equal ones once."""
    return texts.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit("[一-鿿]+"), F.lit(0))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _pieces(runs: DataFrame, longest: int) -> DataFrame:
    """word, before, after, n: every stretch of up to `longest` signs, with the sign on either side ('' at the edge of a run)."""
    size = F.length("run")
    at = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i + 1)), lambda k: F.struct(i.alias("i"), k.alias("k"))))
    each = runs.select("run", "n", F.explode(F.flatten(at)).alias("p"))
    i, k = F.col("p.i"), F.col("p.k")
    return each.select(F.substring("run", i, k).alias("word"), F.when(i > 1, F.substring("run", i - 1, F.lit(1))).otherwise("").alias("before"), F.substring("run", i + k, F.lit(1)).alias("after"), "n")


def _freedom(pieces: DataFrame, side: str) -> DataFrame:
    """word, and the entropy of the signs on one side of it."""
    n = pieces.groupBy("word", side).agg(F.sum("n").alias("n"))
    h = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    return n.groupBy("word").agg(h.alias(f"free_{side}"))


def candidates(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, freedom: float = FREEDOM) -> DataFrame:
    """word, n, cohesion, freedom: single signs, and stretches that stand `least` times, whose parts stand together `cohesion` times as often as by chance at
    every cut, and whose neighbours differ by `freedom` bits on both sides. Null texts have no runs."""
    pieces = _pieces(_runs(texts, text_col), longest)
    counts = stored(pieces.groupBy("word").agg(F.sum("n").alias("n")).filter((F.length("word") == 1) | (F.col("n") >= least)), "pieces")
    total = counts.filter(F.length("word") == 1).agg(F.sum("n")).first()[0] or 0
    cuts = counts.filter(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    parts = lambda name: counts.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    cuts = cuts.select("word", "n", F.left("word", F.col("k")).alias("a"), F.expr("substring(word, k + 1)").alias("b")).join(parts("a"), "a").join(parts("b"), "b")
    tight = cuts.groupBy("word", "n").agg(F.min(F.col("n") * F.lit(float(total)) / F.col("n_a") / F.col("n_b")).alias("cohesion")).filter(F.col("cohesion") >= cohesion)
    near = pieces.join(tight.select("word"), "word", "left_semi")
    free = reduce(lambda a, b: a.join(b, "word"), (_freedom(near, side) for side in ("before", "after")))
    several = tight.join(free, "word").select("word", "n", "cohesion", F.least("free_before", "free_after").alias("freedom")).filter(F.col("freedom") >= freedom)
    one = counts.filter(F.length("word") == 1).select("word", "n", F.lit(None).cast("double").alias("cohesion"), F.lit(None).cast("double").alias("freedom"))
    return several.unionByName(one)


def frequencies(words: DataFrame, most: int = MOST) -> dict[str, int]:
    """A table of words and how often they stand (word, n) as a dictionary for Segmenter, which every task holds: the most frequent `most`, equal ones by word. Repeated words are added up."""
    rows = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return {r.word: r.n for r in rows.toLocalIterator()}


def counted(runs: DataFrame, cutter: Segmenter) -> DataFrame:
    """word, n: the words that the cut of all runs gives."""

    def run(own: pd.Series) -> pd.Series:
        return pd.Series([cutter.run(r) for r in own], index=own.index, dtype=object)

    return runs.select(F.explode(F.pandas_udf(run, "array<string>")("run")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame, text_col: str = "text", rounds: int = 3, known: dict[str, int] | None = None, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, freedom: float = FREEDOM, most: int = MOST) -> dict[str, int]:
    """Words and frequencies of a corpus, for packs.with_frequencies().

    Candidates begin with how often they stand as stretches, together with the words in `known`; each round cuts all runs with the frequencies so far and counts anew, so a stretch that
    mostly belongs to longer words loses its weight. Words that no cut uses any more go. Without Chinese signs nothing is learnt.
    """
    runs = stored(_runs(texts, text_col), "runs")
    found = frequencies(candidates(texts, text_col, longest, least, cohesion, freedom).select("word", "n"), most) | (known or {})
    for _ in range(rounds if found else 0):
        found = frequencies(counted(runs, Segmenter(found)), most)
    return found

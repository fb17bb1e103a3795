"""Text models as tables: word bigrams, and TF-IDF of character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.packs import Pack
from .kernels import char_grams
from .parse import tokens

#: N-grams in the vocabulary at most.
MOST_GRAMS = 5000
#: Weights of n-grams in references that go to every task at most.
MOST_WEIGHTS = 5_000_000
#: Entries of the matrix of n-grams by references that a task holds whole at most; a larger one is walked n-gram by n-gram.
MOST_ENTRIES = 8_000_000
#: Words of which a task remembers the n-grams, at most.
REMEMBERED = 200_000


def _bigrams(rows: DataFrame, pack: Pack, *keys: str) -> DataFrame:
    """w1, w2 of each pair of neighbours, with the keys; and n_tokens."""
    cut = rows.select(*keys, tokens(F.col("text"), pack).alias("_t"))
    pairs = F.zip_with(F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0))), F.slice("_t", F.lit(2), F.greatest(F.size("_t") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    return cut.select(*keys, F.size("_t").alias("n_tokens"), F.explode(pairs).alias("p")).select(*keys, "n_tokens", "p.w1", "p.w2")


def bigram_model(references: DataFrame, pack: Pack) -> DataFrame:
    """w1, w2, p: counts smoothed by one over the words seen after w1."""
    n = _bigrams(references, pack).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("w1")
    return n.select("w1", "w2", ((F.col("n") + 1) / (F.sum("n").over(w) + F.count(F.lit(1)).over(w))).alias("p"))


def average_probability(par: DataFrame, model: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, p_idx, avg_prob: the mean over the pairs that the model knows; -1 under four tokens or three such pairs. Not rounded."""
    met = _bigrams(par, pack, "doc_id", "p_idx").filter("n_tokens >= 4").join(model, ["w1", "w2"])
    mean = met.groupBy("doc_id", "p_idx").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("a"))
    out = par.select("doc_id", "p_idx").join(mean, ["doc_id", "p_idx"], "left")
    return out.select("doc_id", "p_idx", F.when(F.col("n") >= 3, F.col("a")).otherwise(-1.0).alias("avg_prob"))


def _grams(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, gram, tf: how often each text has each n-gram."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([dict(Counter(char_grams(t or ""))) for t in texts], index=texts.index, dtype=object)

    return rows.select(*keys, F.explode(F.pandas_udf(run, "map<string,long>")("text")).alias("gram", "tf"))


def char_model(references: DataFrame, id_col: str, most: int = MOST_GRAMS) -> tuple[DataFrame, DataFrame]:
    """(gram, idf) of the most frequent n-grams (ties by n-gram), and (ref, gram, weight) of the references, each of length 1."""
    tf = _grams(references.select(F.col(id_col).alias("ref"), "text"), "ref").groupBy("ref", "gram").agg(F.sum("tf").alias("tf"))
    total = references.agg(F.count(F.lit(1)).alias("refs"))
    top = tf.groupBy("gram").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("n"), "gram").limit(most)
    vocabulary = top.crossJoin(F.broadcast(total)).select("gram", (F.log((1 + F.col("refs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(vocabulary, "gram").select("ref", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("ref")))
    return vocabulary, raw.select("ref", "gram", (F.col("w") / norm).alias("weight"))


def best_match(rows: DataFrame, keys: list[str], vocabulary: DataFrame, weights: DataFrame, least: int = 10, most: int = MOST_WEIGHTS, entries: int = MOST_ENTRIES) -> DataFrame:
    """keys, similarity: the largest cosine to any reference; 0 for texts under ten characters or without known n-grams.

    The model goes to every task as a sparse matrix as long as it has at most `most` weights; a larger one is met by a join on n-grams.
    """
    n = weights.count()
    rows = rows.select(*keys, "text")
    if n > most:
        tf = _grams(rows.filter(F.length("text") >= least), *keys).groupBy(*keys, "gram").agg(F.sum("tf").alias("tf"))
        own = tf.join(vocabulary, "gram").select(*keys, "gram", (F.col("tf") * F.col("idf")).alias("w"))
        norm = own.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        dots = own.join(weights, "gram").groupBy(*keys, "ref").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
        best = dots.groupBy(*keys).agg(F.max("dot").alias("dot")).join(norm, keys).select(*keys, (F.col("dot") / F.col("norm")).alias("s"))
        return rows.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("s", F.lit(0.0)).alias("similarity"))
    idf = {r.gram: r.idf for r in vocabulary.collect()}
    refs: dict = {}
    by: dict[str, tuple[list[int], list[float]]] = {g: ([], []) for g in idf}
    for r in weights.toLocalIterator():
        by[r.gram][0].append(refs.setdefault(r.ref, len(refs)))
        by[r.gram][1].append(r.weight)
    model = {g: (idf[g], np.array(at, np.int32), np.array(w)) for g, (at, w) in by.items()}
    shared, size = rows.sparkSession.sparkContext.broadcast(model), len(refs)

    def by_matrix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, matrix = shared.value, np.zeros((len(idf), size))
        place, scale = {}, np.zeros(len(idf))
        for k, (g, (factor, at, w)) in enumerate(model.items()):
            place[g], scale[k] = k, factor
            matrix[k, at] = w
        grams: dict[str, list[int]] = {}

        def known(word: str) -> list[int]:
            if len(grams) >= REMEMBERED:
                grams.clear()
            grams[word] = found = [place[g] for g in char_grams(word) if g in place]
            return found

        def of(text: str | None) -> float:
            if not text or len(text) < least:
                return 0.0
            ids = []
            for word in re.split("[ \t\r\n]+", text.lower()):
                if word:
                    own = grams.get(word)
                    ids += known(word) if own is None else own
            if not ids:
                return 0.0
            at, tf = np.unique(np.array(ids), return_counts=True)
            w = tf * scale[at]
            return float((w @ matrix[at]).max() / math.sqrt(w @ w))

        for texts in batches:
            yield pd.Series([of(t) for t in texts], index=texts.index, dtype=float)

    if 0 < size * len(idf) <= entries:
        return rows.select(*keys, F.pandas_udf(by_matrix, "double")("text").alias("similarity"))

    def run(texts: pd.Series) -> pd.Series:
        model = shared.value

        def of(text: str | None) -> float:
            dots, square = np.zeros(size), 0.0
            for g, tf in Counter(char_grams(text)).items() if text and len(text) >= least else ():
                known = model.get(g)
                if known:
                    w = tf * known[0]
                    square += w * w
                    dots[known[1]] += w * known[2]
            return float(dots.max() / math.sqrt(square)) if square and size else 0.0

        return pd.Series([of(t) for t in texts], index=texts.index, dtype=float)

    return rows.select(*keys, F.pandas_udf(run, "double")("text").alias("similarity"))


def save(model: DataFrame, path: str) -> None:
    """Keep a model's table."""
    model.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A model that save() has kept."""
    return spark.read.parquet(path)

"""Sentence features as vectors, and a detector that scores them: a forest with its cut-offs, kept together."""

from __future__ import annotations

import json
from typing import Any

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packs import Pack
from . import sentences as T

# Probabilities from which on a sentence is red, orange, yellow, and the weights of those zones.
CUTS = (0.55, 0.40, 0.28)
WEIGHTS = (1.0, 0.7, 0.4)

#: The numbers of a sentence, in order, each from 0 to 1 but the last three, which are negative where a model has nothing to say.
FEATURES = [
    "lexical_diversity", "char_entropy", "word_repetition", "unique_char_ratio", "char_similarity", "high_connectors", "medium_connectors", "low_connectors", "slop", "template",
    "parallel_starter", "formula", "even_lengths", "place", "uniform", "level", "bigram", "own", "human",
]
#: Nodes of a forest that becomes one expression at most; a larger one goes over batches of numbers.
MOST_NODES = 4000
#: Changes when features do: a detector is only used with those that it has learnt from.
VERSION = 2

Tree = Any  # a leaf's probability, or (feature, threshold, tree where it is at most that, tree where it is more)


def inputs(pack: Pack) -> list[Column]:
    """The nineteen numbers, from the columns of sentences.sentence_rows()."""
    part = lambda c, k: F.least(c / F.lit(float(k)), F.lit(1.0))
    like = F.when(F.col("chars") >= 10, F.coalesce("_like", F.lit(0.0))).otherwise(0.0)
    place = F.when(F.col("s_idx") == 0, 1.0).when(F.col("s_idx") == F.col("n_sents") - 1, 0.6).otherwise(0.0)
    level = F.when(F.col("level") == "deep_red", 1.0).when(F.col("level") == "red", 0.7).when(F.col("level") == "yellow", 0.4).otherwise(0.0)
    values = [
        F.col("lexical_diversity"), part(F.col("char_entropy"), 8), part(F.col("word_repetition"), 5), F.col("unique_char_ratio"), like,
        part(F.col("_high"), 3), part(F.col("_medium"), 3), part(F.col("_low"), 3), F.when(F.col("_slop") > 0, 1.0).otherwise(0.0),
        part(F.col("template"), 0.40), F.when(F.col("_starts"), 1.0).otherwise(0.0), F.when(T.by_formula([w for _, w, _ in pack.formulas]).cast("double") > 0, 1.0).otherwise(0.0), part(F.col("even"), 0.10), place,
        part(F.col("uniform"), 0.14), level, part(F.col("bigram"), 0.10), part(F.col("own"), 0.15), part(F.col("human"), 0.16),
    ]
    return [v.cast("double") for v in values]


def features(par: DataFrame, pack: Pack, extra: DataFrame | None = None, char_sim: DataFrame | None = None) -> DataFrame:
    """doc_id, p_idx, s_idx, chars, features: nineteen numbers a sentence, of sentences of five characters and more.

    `extra` may have bigram, own, human and uniform by paragraph (doc_id, p_idx), as sentences.*_signal() give them, and `char_sim` the similarity
    of sentences to known texts (doc_id, p_idx, s_idx), which counts from ten characters on; what is not given is 0, but own comes from the paragraph.
    """
    rows = T.sentence_rows(par, pack, extra, char_sim)
    return rows.select("doc_id", "p_idx", "s_idx", "chars", array_to_vector(F.array(*inputs(pack))).alias("features"))


def train(rows: DataFrame, label_col: str = "label", trees: int = 20, depth: int = 5, seed: int = 7) -> RandomForestClassificationModel:
    return RandomForestClassifier(labelCol=label_col, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def trees_of(model: RandomForestClassificationModel) -> list[Tree]:
    """The trees of a learnt forest, with the probability of class 1 in each leaf."""

    def tree(node) -> Tree:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return stats[1] / sum(stats)
        split = node.split()
        return (split.featureIndex(), split.threshold(), tree(node.leftChild()), tree(node.rightChild()))

    return [tree(t.rootNode()) for t in model._java_obj.trees()]


def size(tree: Tree) -> int:
    return 1 if isinstance(tree, float | int) else 1 + size(tree[2]) + size(tree[3])


def _case(tree: Tree, values: list[Column]) -> Column:
    if isinstance(tree, float | int):
        return F.lit(float(tree))
    return F.when(values[tree[0]] <= F.lit(float(tree[1])), _case(tree[2], values)).otherwise(_case(tree[3], values))


def tree_sql(tree: Tree, values: list[str]) -> str:
    """A tree as a CASE expression of SQL."""
    if isinstance(tree, float | int):
        return f"{float(tree)!r}::DOUBLE"
    return f"CASE WHEN {values[tree[0]]} <= {float(tree[1])!r}::DOUBLE THEN {tree_sql(tree[2], values)} ELSE {tree_sql(tree[3], values)} END"


def _walked(tree: Tree, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if isinstance(tree, float | int):
        out[rows] += tree
        return
    left = x[rows, tree[0]] <= tree[1]
    _walked(tree[2], x, rows[left], out)
    _walked(tree[3], x, rows[~left], out)


def read_cuts(spark: SparkSession, path: str) -> dict[str, float]:
    """Cut-offs and weights of a JSON file with red_threshold, orange_threshold, yellow_threshold and red_weight, orange_weight, yellow_weight. ValueError where one is missing."""
    names = [f"{zone}_{kind}" for kind in ("threshold", "weight") for zone in ("red", "orange", "yellow")]
    row = spark.read.schema(", ".join(f"{n} double" for n in names)).option("multiLine", "true").json(path).first()
    if row is None or None in tuple(row):
        raise ValueError(f"{path} must have {', '.join(names)}")
    return row.asDict()


class Detector(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A forest with its cut-offs, weights and version: a stage of Spark ML, which is saved and loaded whole (detector.write().overwrite().save(path), Detector.load(path)).

    transform() adds probability and zone to rows with a vector `features`; sentences.zones_raw(..., model=detector) uses it in a scan. A small forest is one expression of CASEs, which Spark
    compiles with the rest of the query.
    """

    trees = Param(Params._dummy(), "trees", "the trees as JSON", typeConverter=TypeConverters.toString)
    cuts = Param(Params._dummy(), "cuts", "probabilities from which on a sentence is red, orange, yellow", typeConverter=TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "what a character of a red, orange, yellow sentence counts in weighted_rate()", typeConverter=TypeConverters.toListFloat)
    version = Param(Params._dummy(), "version", "of the features", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, trees: str = "[]", cuts: list[float] | None = None, weights: list[float] | None = None, version: int = VERSION):
        super().__init__()
        self._setDefault(cuts=list(CUTS), weights=list(WEIGHTS), version=VERSION)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, forest: RandomForestClassificationModel | list[Tree], found: dict[str, float] | None = None) -> Detector:
        """From a learnt forest or its trees; `found` as read_cuts() gives it."""
        trees = forest if isinstance(forest, list) else trees_of(forest)
        zones = ("red", "orange", "yellow")
        cuts, weights = ([found[f"{z}_{kind}"] for z in zones] if found else None for kind in ("threshold", "weight"))
        return cls(trees=json.dumps(trees), cuts=cuts, weights=weights)

    @property
    def forest(self) -> list[Tree]:
        if self.getOrDefault(self.version) != VERSION:
            raise ValueError(f"this detector has learnt from features of version {self.getOrDefault(self.version)}, not {VERSION}")
        return json.loads(self.getOrDefault(self.trees))

    def scanned(self, rows: DataFrame, pack: Pack) -> DataFrame:
        """Adds probability and zone to the rows of sentences.sentence_rows()."""
        return self.scored(rows, F.array(*inputs(pack)))

    def probability(self, values: list[Column]) -> Column:
        """The mean of the trees' probabilities; null without trees."""
        forest = self.forest
        if not forest:
            return F.lit(None).cast("double")
        if sum(map(size, forest)) <= MOST_NODES:
            total = F.lit(0.0)
            for tree in forest:
                total = total + _case(tree, values)
            return total / F.lit(float(len(forest)))

        def run(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(float) for c in columns], 1)
            out = np.zeros(len(x))
            for tree in forest:
                _walked(tree, x, np.arange(len(x)), out)
            return pd.Series(out / len(forest), index=columns[0].index)

        return F.pandas_udf(run, "double")(*values)

    def zone(self, probability: Column) -> Column:
        """By the probability to six places: sums of trees must not hang on the last bit."""
        p = F.round(probability, 6)
        red, orange, yellow = self.getOrDefault(self.cuts)
        return F.when(p >= red, "red").when(p >= orange, "orange").when(p >= yellow, "yellow").otherwise("green")

    def weighted_rate(self, rows: DataFrame) -> DataFrame:
        """doc_id, weighted_rate: the share of characters in suspect sentences, each by its zone's weight; not rounded."""
        weight = F.lit(0.0)
        for zone, w in zip(("yellow", "orange", "red"), reversed(self.getOrDefault(self.weights)), strict=True):
            weight = F.when(F.col("zone") == zone, w).otherwise(weight)
        return rows.groupBy("doc_id").agg((F.sum(F.col("chars") * weight) / F.sum("chars")).alias("weighted_rate"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.scored(dataset, vector_to_array(F.col("features")))

    def scored(self, rows: DataFrame, values: Column) -> DataFrame:
        """Adds probability and zone, from an array of the numbers; as a column of its own, so that it is made once for all nodes."""
        own = max(rows.columns, key=len) + "_numbers"
        out = rows.withColumn(own, values)
        out = out.withColumn("probability", self.probability([F.get(own, F.lit(k)) for k in range(len(FEATURES))]))
        return out.withColumn("zone", self.zone(F.col("probability"))).drop(own)

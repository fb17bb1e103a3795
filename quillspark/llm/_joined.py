"""Language models too large for one machine: kept as a table of differences, and met by joins.

The log-likelihood of toxic over ordinary of a word after another is a sum: what a word without evidence has, what the word adds,
what its context adds and what the pair adds. Each of the last three is a row of the table if it is not 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._filters import Filter
from ._shared import slices, text_bytes, written
from ._words import LOWER, NOT_ALNUM, Words, mix

#: Bits of the filter of keys at most; the fuller it is, the more keys that are not in the table pass, and those fall out in the join.
FILTER_BITS = 32
_WORD, _CONTEXT, _PAIR = (np.uint64(x) for x in (0x517CC1B727220A95, 0x2545F4914F6CDD1D, 0x9E6C63D0676A9A99))


def _key(hashes: np.ndarray, kind: np.uint64) -> np.ndarray:
    return mix(hashes ^ kind)


def _met(df: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join whose exchanges serve nothing else, so that those of frequent keys can be split."""
    salt = F.xxhash64(key).alias("_salt")
    return df.select("*", salt).join(other.select("*", salt), ["_salt", key], how).drop("_salt")


def _weighed(df: DataFrame, kinds: float) -> DataFrame:
    """Adds the evidence by a0, a1 and share; rows without any go."""
    from .toxicity import _weight

    at = [df.columns.index(x) for x in ("a0", "a1", "share")]

    def run(batches):
        for batch in batches:
            a0, a1, share = (np.asarray(batch.column(k)).astype(float) for k in at)
            weight = _weight(np.stack([a0, a1]), share, kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], [*batch.schema.names, "weight"]).filter(pa.array(weight > 0))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("weight", DoubleType())]))


def _keyed(df: DataFrame, kind: np.uint64, *columns: str) -> DataFrame:
    """key, d: of the hash in one column or of the pair in two."""
    from .toxicity import pair_hash

    def run(batches):
        for batch in batches:
            h = [np.asarray(batch.column(k)).view(np.uint64) for k in range(len(columns))]
            key = _key(h[0] if len(h) == 1 else pair_hash(*h), kind)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(len(columns))], ["key", "d"])

    return df.select(*columns, "d").mapInArrow(run, "key long, d double")


class JoinedModel:
    """deltas: key, d; base: the ratio of a word without evidence."""

    def __init__(self, deltas: DataFrame, base: float):
        self.deltas, self.base = deltas, base
        self.filter = Filter(deltas.select("key"), FILTER_BITS)

    def ratios(self, texts: DataFrame) -> DataFrame:
        """tk, ratio: of each distinct text of the column `text`, by its xxhash64."""
        from .toxicity import BEGIN, pair_hash

        shared = texts.sparkSession.sparkContext.broadcast(self.filter)

        def run(batches):
            for batch in batches:
                raw, at = text_bytes(batch.column(0))
                tks = np.asarray(batch.column(1))
                for i, j in slices(at):
                    words = Words(LOWER[raw[at[i] : at[j]]], at[i : j + 1] - at[i], NOT_ALNUM)
                    h, n = words.hash, words.counts()
                    yield pa.RecordBatch.from_arrays([pa.array(tks[i:j]), pa.nulls(j - i, pa.int64()), pa.array(n, pa.int64())], ["tk", "key", "many"])
                    if not len(h):
                        continue
                    before = np.concatenate([[BEGIN], h[:-1]])
                    before[words.at[:-1][words.at[:-1] < len(h)]] = BEGIN
                    keys = np.concatenate([_key(h, _WORD), _key(before, _CONTEXT), _key(pair_hash(before, h), _PAIR)])
                    own = np.tile(np.repeat(np.arange(j - i), n), 3)
                    use = shared.value.passing(keys)
                    keys, own = keys[use].view(np.int64), own[use]
                    order = np.lexsort((keys, own))
                    keys, own = keys[order], own[order]
                    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])) if len(keys) else np.zeros(0, int)
                    yield pa.RecordBatch.from_arrays([pa.array(tks[i:j][own[new]]), pa.array(keys[new]), pa.array(np.diff(np.append(new, len(keys))), pa.int64())], ["tk", "key", "many"])

        # equal texts are counted once; of one text, a stretch of a batch has all rows
        found = texts.select("text", F.xxhash64("text").alias("tk")).mapInArrow(run, "tk long, key long, many long").groupBy("tk", "key").agg(F.max("many").alias("many"))
        sums = _met(found.filter("key IS NOT NULL"), self.deltas, "key").groupBy("tk").agg(F.sum(F.col("many") * F.col("d")).alias("s"))
        sizes = found.filter("key IS NULL").select("tk", F.col("many").alias("n"))
        return sizes.join(sums, "tk", "left").select("tk", F.when(F.col("n") > 0, self.base + F.coalesce("s", F.lit(0.0)) / F.col("n")).otherwise(self.base).alias("ratio"))


def joined_models(pairs: DataFrame, words: DataFrame, told: DataFrame, totals: np.ndarray, size: dict):
    """A function from folds to their model. pairs: first, second, n0 to n3; words, told: word, n0 to n3, t0 to t3 of all words, and of those with evidence in any model."""
    from .toxicity import DISCOUNT, MODELS, _share

    counts = lambda p, m, c: reduce_sum(F.col(f"{p}{2 * f + c}") for f in m)
    reduce_sum = lambda parts: sum(parts, F.lit(0))
    there = [F.sum(x.cast("long")) for m in MODELS for x in (counts("n", m, 0) > 0, counts("n", m, 1) > 0, counts("n", m, 0) + counts("n", m, 1) > 0)]
    named = [x.alias(f"c{k}") for k, x in enumerate(there)]
    whole = [x or 0 for x in pairs.agg(*named).first()]
    contexts = pairs.groupBy(F.col("second").alias("word")).agg(*named)
    told = written(_met(told, contexts, "word", "left").na.fill(0), "told")

    def model(m: tuple[int, ...]) -> JoinedModel:
        k, share = 3 * MODELS.index(m), _share(totals[list(m)].sum(0))
        shared = (counts("n", m, 0) + counts("n", m, 1) + 1) / float(totals[list(m)].sum() + size[m] + 1)
        w = told.select("word", *(counts("n", m, c).alias(f"a{c}") for c in (0, 1)), F.lit(share).alias("share"), F.col(f"c{k}").alias("k0"), F.col(f"c{k + 1}").alias("k1"), shared.alias("shared"))
        mixed = F.col("weight") * F.col("a1") / F.greatest(F.col("a0") + F.col("a1"), F.lit(1)) + (1 - F.col("weight")) * share
        w = written(_weighed(w, size[m]).withColumn("expected", F.least(F.greatest(mixed, F.lit(1e-3 * share)), F.lit(1 - 1e-3 * (1 - share)))), "told")
        off = lambda c: F.least(F.col(f"k{c}").cast("double"), F.lit(DISCOUNT))
        s = w.agg(F.sum(F.col("weight") * F.col("shared")), *(F.sum(F.col("weight") * x) for c in (0, 1) for x in (F.col(f"k{c}"), off(c)))).first()
        z, *s = [x or 0.0 for x in s]
        rest, one, alone = max(1.0 - z, 1e-9), [], []
        for c in (0, 1):
            every = whole[k + c] + DISCOUNT
            untold, given = (whole[k + c] - s[2 * c]) / every, (s[2 * c + 1] + DISCOUNT) / every
            one.append(F.col("weight") * (F.col(f"k{c}") - off(c)) / every + untold * (1 - F.col("weight")) * F.col("shared") / rest + given * F.col("shared"))
            alone.append(untold / rest + given)
        base = math.log(alone[1]) - math.log(alone[0])
        own = w.select("word", "expected", *(x.alias(f"p{c}") for c, x in enumerate(one)))

        met = pairs.select("first", "second", *(counts("n", m, c).alias(f"a{c}") for c in (0, 1)))
        met = _met(met, own.withColumnRenamed("word", "second"), "second", "left").withColumn("share", F.coalesce("expected", F.lit(share))).drop("expected")
        met = _weighed(met, max(whole[k + 2], size[m]))
        met = _met(met, words.select(F.col("word").alias("first"), *(counts("t", m, c).alias(f"t{c}") for c in (0, 1))), "first")
        met = written(_met(met, words.select(F.col("word").alias("second"), shared.alias("shared")), "second", "left"), "told")
        mass = lambda c: F.col("weight") * F.greatest(F.col(f"a{c}") - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"t{c}"), F.lit(1))
        left = met.groupBy("first").agg(*((1 - F.sum(mass(c))).alias(f"l{c}") for c in (0, 1)))
        lone = lambda c: F.coalesce(f"p{c}", alone[c] * F.col("shared"))
        after = [F.col(f"l{c}") * lone(c) + mass(c) for c in (0, 1)]
        of_word, of_context = F.log(lone(1)) - F.log(lone(0)), F.log("l1") - F.log("l0")
        deltas = _keyed(own.withColumn("d", F.log("p1") - F.log("p0") - base), _WORD, "word")
        deltas = deltas.unionByName(_keyed(left.withColumn("d", of_context), _CONTEXT, "first"))
        deltas = deltas.unionByName(_keyed(_met(met, left, "first").withColumn("d", F.log(after[1]) - F.log(after[0]) - of_word - of_context), _PAIR, "first", "second"))
        return JoinedModel(written(deltas, "model"), base)

    return model

"""Lexicons of any size over texts of any number."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.phrases import Book

#: Phrases that every task holds at most; a larger lexicon goes over the texts part by part.
MOST = 1_000_000


def _parts(lexicon: DataFrame, most: int) -> Iterable[list[str]]:
    """The distinct phrases, in lists of about `most`."""
    own = lexicon.select("phrase").filter("phrase <> ''").distinct()
    parts = max(1, -(-own.count() // most))
    for k in range(parts):
        found = [r.phrase for r in own.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == k).toLocalIterator()]
        if found:
            yield found


def counted(rows: DataFrame, keys: list[str], lexicon: DataFrame, text_col: str = "text", most: int = MOST) -> DataFrame:
    """keys, phrase, n: how often each phrase of the lexicon (a column phrase) stands in each text, without overlap, where it does.

    One pass over the texts, whatever the number of phrases up to `most`; no row moves. Phrases are compared as they are, sign by sign; null and empty texts and phrases have and give nothing.
    """
    asked, spark = rows.select(*keys, F.col(text_col).alias("text")), rows.sparkSession
    schema = StructType([*asked.schema.fields[:-1], StructField("phrase", StringType()), StructField("n", LongType())])
    out = None
    for part in _parts(lexicon, most):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            own = Book(shared.value)
            for batch in batches:
                at, found, n = [], [], []
                for k, text in enumerate(batch.column(len(keys)).to_pylist()):
                    for i, c in own.counts(text).items():
                        at.append(k)
                        found.append(own.phrases[i])
                        n.append(c)
                kept = batch.select(range(len(keys))).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string()), pa.array(n, pa.int64())], schema.names)

        each = asked.mapInArrow(run, schema)
        out = each if out is None else out.unionByName(each)
    return out if out is not None else spark.createDataFrame([], schema)


def densities(rows: DataFrame, keys: list[str], lexicon: DataFrame, text_col: str = "text", most: int = MOST) -> DataFrame:
    """keys, lexicon, level, n, hits, density: occurrences of a lexicon's phrases in each text that has any, how many different ones, and how many occurrences in a thousand signs.

    lexicon: lexicon, level, phrase; a phrase may stand in several.
    """
    found = counted(rows, keys, lexicon, text_col, most).join(lexicon.select("lexicon", "level", "phrase").distinct(), "phrase")
    each = found.groupBy(*keys, "lexicon", "level").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hits"))
    size = rows.select(*keys, F.length(text_col).alias("_size"))
    return each.join(size, keys).select(*keys, "lexicon", "level", "n", "hits", (1000 * F.col("n") / F.col("_size")).alias("density"))

"""Texts to paragraphs, sentences and tokens. Positions are columns; row order means nothing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packs import Pack
from ..functions.text import strip


def paragraphs(docs: DataFrame, pack: Pack, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_idx, text, prev: paragraphs above the least length, numbered densely from 0, each with the one before it ('' for the first)."""
    parts = F.filter(F.transform(F.split(F.col(text_col), pack.paragraph), strip), lambda x: F.length(x) > pack.least_paragraph)
    own = docs.select(F.col(id_col).alias("doc_id"), parts.alias("parts"))
    return own.select("doc_id", F.posexplode(_paired("parts")).alias("p_idx", "p")).select("doc_id", "p_idx", "p.text", "p.prev")


def _paired(column: str) -> Column:
    before = lambda i: F.coalesce(F.get(F.col(column), i - 1), F.lit(""))
    return F.transform(column, lambda x, i: F.struct(x.alias("text"), before(i).alias("prev")))


def ordered_paragraphs(rows: DataFrame, id_col: str, order_col: str, text_col: str = "text") -> DataFrame:
    """The same from a table that has one row a paragraph, such as the turns of a conversation."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("p_idx")
    own = rows.select(F.col(id_col).alias("doc_id"), F.col(order_col).cast("int").alias("p_idx"), F.col(text_col).alias("text"))
    return own.withColumn("prev", F.coalesce(F.lag("text").over(w), F.lit("")))


def sentence_array(text: Column, pack: Pack) -> Column:
    """Sentences above the least length, in order."""
    return F.filter(F.transform(F.split(text, pack.sentence), strip), lambda x: F.length(x) > pack.least_sentence)


def sentences(par: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, p_idx, s_idx, sentence, chars"""
    out = par.select("doc_id", "p_idx", F.posexplode(sentence_array(F.col("text"), pack)).alias("s_idx", "sentence"))
    return out.withColumn("chars", F.length("sentence"))


def boundary_sentences(par: DataFrame, pack: Pack) -> DataFrame:
    """The first and last sentence of each paragraph; without one, its first and last 50 characters."""
    own = F.filter(F.transform(F.split("text", pack.edge), strip), lambda x: x != "")
    cut = par.select("doc_id", "p_idx", "text", own.alias("e"))
    first = F.when(F.size("e") > 0, F.get("e", F.lit(0))).otherwise(F.left("text", F.lit(50)))
    last = F.when(F.size("e") > 0, F.get("e", F.size("e") - 1)).otherwise(F.right("text", F.lit(50)))
    return cut.select("doc_id", "p_idx", first.alias("first_sentence"), last.alias("last_sentence"))


def tokens(text: Column, pack: Pack) -> Column:
    """The words of a text in lower case, in order; null for a null text."""
    if pack.cutter is None:
        return F.regexp_extract_all(F.lower(text), F.lit(pack.token), F.lit(0))
    cutter = pack.cutter

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cutter.cut(t) for t in texts], index=texts.index, dtype=object)

    return F.pandas_udf(run, "array<string>")(F.lower(text))

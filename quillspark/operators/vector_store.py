"""Vectors kept by what they are of: a text is encoded once for each version of an encoder, however often and wherever it stands."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import dot
from .semantic import encoded

SCHEMA = "digest string, vec array<double>"


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class VectorStore:
    """A folder of tables of digests and vectors, for one version of an encoder.

    What is missing is found by an anti-join, encoded and written into a folder of its own, which becomes part of the store by being renamed: so readers see a batch whole or not at all, and what a failed run left is no part of
    it. Two runs that fill the store at the same time may both encode a text; either vector serves.
    """

    def __init__(self, spark: SparkSession, path: str, version: str, make, strict: bool = False):
        """make: as in semantic.encoded(). version: names the encoder; vectors of others are not mixed in. strict: errors of the encoder fail the run; else texts without vectors are tried again at the next."""
        self.spark, self.make, self.strict = spark, make, strict
        self.root = f"{path.rstrip('/')}/version={version}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def kept(self) -> DataFrame:
        """digest, vec of all texts that the store has."""
        fs, root = self._fs(self.root)
        found = [s.getPath().toString() for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName().startswith("part-")]
        rows = self.spark.read.schema(SCHEMA).parquet(*found).filter("vec IS NOT NULL") if found else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy("digest").agg(F.first("vec").alias("vec")) if len(found) > 1 else rows

    def fill(self, texts: DataFrame, *columns: str) -> int:
        """Encode the texts of these columns that the store lacks; how many were encoded. All columns are encoded in one pass, equal texts once."""
        each = F.explode(F.array(*(F.struct(digest(F.col(c)).alias("digest"), F.coalesce(F.col(c), F.lit("")).alias("text")) for c in columns))).alias("t")
        # a digest stands for its text, so any of equal rows will do
        wanted = texts.select(each).select("t.*").join(self.kept().select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
        new = f"{self.root}/_new-{uuid.uuid4().hex}"
        # a filter on vectors here would encode all texts twice
        encoded(wanted, "text", self.make, strict=self.strict).select("digest", "vec").write.parquet(new)
        n = self.spark.read.schema(SCHEMA).parquet(new).filter("vec IS NOT NULL").count()
        fs, p = self._fs(new)
        if not n:
            fs.delete(p, True)
        elif not fs.rename(p, self._fs(new.replace("/_new-", "/part-"))[1]):
            raise OSError(f"{new} could not be published")
        return n

    def with_vectors(self, rows: DataFrame, vectors: dict[str, str]) -> DataFrame:
        """Adds vectors by the names and text columns given, filling the store first; null where the encoder failed."""
        self.fill(rows, *vectors.values())
        kept = self.kept()
        for vec, text in vectors.items():
            key = max(rows.columns, key=len) + "_digest"
            rows = rows.withColumn(key, digest(F.col(text))).join(kept.select(F.col("digest").alias(key), F.col("vec").alias(vec)), key, "left").drop(key)
        return rows


def paragraph_similarity(par: DataFrame, store: VectorStore) -> DataFrame:
    """doc_id, p_idx, paragraph_similarity: the product of a paragraph's vector and the one's before it, to four places and from -1 to 1; 0 without one before it or without a text. Null where a vector is wanting."""
    w = Window.partitionBy("doc_id").orderBy("p_idx")
    rows = store.with_vectors(par.select("doc_id", "p_idx", "text"), {"vec": "text"})
    like = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("vec"), F.lag("vec").over(w)))), 4)
    none = F.lag("text").over(w).isNull() | (F.lag("text").over(w) == "") | (F.coalesce("text", F.lit("")) == "")
    return rows.select("doc_id", "p_idx", F.when(none, 0.0).otherwise(like).alias("paragraph_similarity"))


def dimensions(par: DataFrame, pack, store: VectorStore) -> DataFrame:
    """The twelve statistics with the likeness to the paragraph before by vectors; by words where a vector is wanting."""
    from . import dimensions as D

    own = paragraph_similarity(par, store).withColumnRenamed("paragraph_similarity", "_by_vectors")
    dims = D.dimensions(par, pack)
    return dims.join(own, ["doc_id", "p_idx"], "left").withColumn("paragraph_similarity", F.coalesce("_by_vectors", "paragraph_similarity")).select(dims.columns)

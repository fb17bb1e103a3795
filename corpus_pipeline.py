"""From raw documents to packed sequences: five stages, each on what the one before it kept.

toxicity drops documents that score as toxic; exact dedup keeps one of equal texts; near dedup keeps one document of each
component; decontamination drops documents that hold benchmark passages; packing gives the pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _shared
from quillspark.llm.decontaminate import uncontaminated
from quillspark.llm.exact_dedup import WHITE, exact_dedup
from quillspark.llm.near_dedup import near_dedup
from quillspark.llm.packing import pack
from quillspark.llm.toxicity import THRESHOLD, fit, scored

#: Keys of documents that go, which are sent to every executor; more are met by a shuffle.
SENT = 2_000_000
#: The token that ends a document.
END_ID = 1


def _gone(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The documents without those of the keys found. Few go: their keys are sent to the documents, as long as there are at most SENT."""
    found = _shared.written(found, "gone", docs.count())
    return docs.join(F.broadcast(found) if found.count() <= SENT else found, key, "left_anti").select(docs.columns)


def _without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents but those of whose rows none is kept; rows without an id stay."""
    gone = verdicts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("any")).filter("NOT any").select("doc_id")
    return _gone(docs, gone, "doc_id")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold. The models learn from the labelled ones among `docs`."""
    model, score = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), max(docs.columns, key=len) + "_toxicity"
    return scored(docs, model, score_col=score).filter(F.col(score) < THRESHOLD).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; also where rows repeat an id or have none."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("odd"))
    if odd.isEmpty():
        return _without(docs, exact_dedup(docs))
    # an id alone does not tell these rows apart: of those that the verdict keeps, one of each text stays
    verdicts, name = _shared.written(exact_dedup(docs), "verdicts"), max(docs.columns, key=len)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    keep = verdicts.filter("kept").select(F.col("doc_id").alias(f"{name}_id"), F.col("text_sha256").alias(f"{name}_sha")).distinct()
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), WHITE, "")
    rows = docs.join(odd, same("doc_id", "odd"), "left_semi").withColumn(f"{name}_own", F.sha2(norm, 256))
    rows = rows.join(keep, same("doc_id", f"{name}_id") & same(f"{name}_own", f"{name}_sha"), "left_semi").dropDuplicates([f"{name}_own"]).select(docs.columns)
    return _without(docs.join(odd, same("doc_id", "odd"), "left_anti"), verdicts).unionByName(rows)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return _without(docs, near_dedup(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that all documents are packed into."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", clean),
    ("packing", packing),
]

#: The first stage scores with a model and the last encodes with a tokenizer, which SQL can't do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table `documents`; each one's result is written and read again for the next, and what it needed in the meantime removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), _shared.made()
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = _shared.scratch(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        _shared.delete(spark, *(p for p in _shared.made() if p not in before and p != path))
    return STAGES[-1][1](spark, docs, sf_dir)

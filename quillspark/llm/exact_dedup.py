"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

Each text, freed of white space, is cut where its own content says so. Chunks
are deduplicated by content; their identifiers are verified there: as long as
two different chunks share one, all get a wider one. A document is then
the ordered list of its chunk identifiers, and only those lists are grouped
and joined. The full texts cross the network once, as deduplicated chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import written

#: Characters that are no part of the compared text.
WHITE = r"[\x20\x09-\x0D]"
#: A chunk ends after one of these, once it is long enough.
BREAKS = ".!?;:。！？；"


def _identifiers() -> list:
    """From short to long; the last is the chunk itself, for which nothing can collide."""
    return [F.xxhash64, lambda c: F.sha2(c, 256), lambda c: c]


def chunks(text: Column, least: int, most: int) -> Column:
    """The text's content-defined chunks in order; none for an empty text."""
    cut = rf"(?s).{{{least},{most}}}?[{BREAKS}]|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def verified(parts: DataFrame, identify) -> bool:
    """Whether no two different chunks of the column `parts` share an identifier."""
    distinct = parts.select(F.explode("parts").alias("c")).select(identify(F.col("c")).alias("i"), "c").distinct()
    return distinct.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 512, most: int = 4096, identifiers: list | None = None
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without white space. Of equal texts, that
    with the most code points stays; of those, the smallest id; a null id comes last.
    A null text is an empty one, and empty texts are equal. A row that repeats another row's id gets a row too, with
    the same verdict. An empty table gives no rows. Other columns are not read, so their names are free.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), raw.alias("raw")).select("id", F.length("raw").alias("n"), F.regexp_replace("raw", WHITE, "").alias("norm"))
    cut = base.select("id", "n", F.sha2("norm", 256).alias("sha"), chunks(F.col("norm"), least, most).alias("parts"))
    options = identifiers or _identifiers()
    identify = next((f for f in options[:-1] if verified(cut.select("parts"), f)), options[-1])
    # read twice, so cut and hashed once
    rows = written(cut.select("id", "n", "sha", F.transform("parts", lambda c: identify(c)).alias("recipe")), "recipes")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    groups = rows.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
    # with the hash as a further key, the join has exchanges of its own, of which a large group's can be split
    keyed = F.xxhash64("recipe").alias("key")
    return rows.select("*", keyed).join(groups.select("*", keyed), ["key", "recipe"]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("best.id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLES = {
    "op1_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
}

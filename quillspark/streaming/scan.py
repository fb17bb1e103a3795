"""Streams: paragraphs scanned as documents arrive, and events counted by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.packs import LATIN, Pack
from ..operators.dimensions import scanned
from ..operators.parse import paragraphs
from ..sources import stored


def table_stream(spark: SparkSession, folder: str, table: str, files: int = 8) -> DataFrame:
    """A table's files as a stream; the table is a file or a folder."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def levels(docs: DataFrame, pack: Pack = LATIN) -> DataFrame:
    """doc_id, p_idx, level of each paragraph. No step looks beyond its document, so the batch operators serve streams as they are."""
    rows = scanned(paragraphs(docs, pack), pack)
    return rows.select("doc_id", "p_idx", "ai_count", "level")


def event_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each type and window; what comes later than `late` is left out of a running stream. Times without a zone count as UTC, and so does `day`."""
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        events = events.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)")))
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.expr("timestampadd(MICROSECOND, unix_micros(w.start), timestamp_ntz'1970-01-01')").alias("day"), "event_type", "n", "total")


def drained(stream: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All that a stream gives from what is there now, as a table of files in the shared folder, with its checkpoint beside it.

    With keys, a row replaces the one of the same keys from an earlier batch, as updates of an aggregate do; so the watermark may drop old state.
    """
    spark, out = stream.sparkSession, stored.place(stream.sparkSession, "stream")
    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that runs again writes the same folder anew
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    q = stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    if not q.lastProgress:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    if not keys:
        return rows.drop("_batch")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("last"))
    return last.select(*(c if c in keys else F.col(f"last.{c}").alias(c) for c in stream.columns))

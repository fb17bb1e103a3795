"""Vector compression by codebooks of parts: weighted Lloyd over distinct parts.

Vectors become integers and are cut into parts. Equal parts of one position are counted once, with their number as weight, so
that copies of a vector, however many, cost one row in every round. Rounds send sums of entries, never rows. At the end each
distinct part has its code, and a join takes codes and errors back to the vectors.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from ._shared import written

#: Components are multiplied by it before they are rounded down.
SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Larger integers (of components beyond 1e15) count as this one.
MOST = 1 << 62

Books = dict[int, list[np.ndarray]]  # by length of the vectors, for each part: entries x components, of Python's integers


def _cuts(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end; lengths differ by one at most."""
    return [k * length // parts for k in range(parts + 1)]


def _finite(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors without null or non-finite components: their rows, lengths and all components."""
    sizes = np.asarray(pc.list_value_length(column).fill_null(-1))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    odd = np.bincount(owner[~np.isfinite(values)], minlength=len(sizes)) > 0
    use = (sizes >= 0) & ~odd
    return np.flatnonzero(use), sizes[use], values[use[owner]]


def _bytes(part: np.ndarray) -> bytes:
    return part.astype("<i4" if (abs(part) < 1 << 31).all() else "<i8").tobytes()


def _whole(vectors: DataFrame, scale: int, parts: int) -> DataFrame:
    """Vectors as integers in parts: length, and the bytes of each part (four a component, or eight where a larger one is in it)."""

    def run(batches):
        for batch in batches:
            rows, sizes, values = _finite(batch.column(batch.num_columns - 1))
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(values * scale), -MOST, MOST).astype(np.int64)
            ends = np.cumsum(sizes)
            if len(rows) and (sizes == sizes[0]).all() and (abs(whole) < 1 << 31).all():
                offsets = 4 * (np.arange(len(rows))[:, None] * sizes[0] + np.array(_cuts(int(sizes[0]), parts)[:-1])).ravel()
                flat = pa.Array.from_buffers(pa.binary(), len(rows) * parts, [None, pa.py_buffer(np.append(offsets, 4 * len(whole)).astype(np.int32)), pa.py_buffer(whole.astype("<i4"))])
            else:
                pieces = [_bytes(whole[e - n :][a:b]) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True) for a, b in pairwise(_cuts(n, parts))]
                flat = pa.array(pieces, pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * parts), flat)
            kept = batch.select(range(batch.num_columns - 1)).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes, pa.int32()), lists], [*kept.schema.names, "length", "parts"])

    schema = StructType([*vectors.schema.fields[:-1], StructField("length", IntegerType()), StructField("parts", ArrayType(BinaryType()))])
    return vectors.mapInArrow(run, schema)


def _numbers(data: list[bytes], width: int) -> np.ndarray:
    """Parts of so many components, one a row."""
    if all(len(b) == 4 * width for b in data):
        return np.frombuffer(b"".join(data), "<i4").reshape(len(data), width).astype(np.int64)
    return np.array([np.frombuffer(b, "<i4" if len(b) == 4 * width else "<i8") for b in data], np.int64).reshape(len(data), width)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (the first of equal ones), and its squared distance: exact, whatever the size of the integers."""
    width = rows.shape[1]
    most = max(int(abs(x).max()) if x.size else 0 for x in (rows, entries))
    if 4 * width * most * most < 1 << 52:  # doubles hold every sum
        x, c = rows.astype(np.float64), entries.astype(np.float64)
        all_ = (c * c).sum(1) - 2 * (x @ c.T) + (x * x).sum(1)[:, None]
        best = all_.argmin(1)
        return best, all_[np.arange(len(x)), best].astype(np.int64)
    x = rows.astype(object)
    all_ = np.stack([((x - c) ** 2).sum(1) for c in entries.astype(object)], 1)
    best = np.array([min(range(len(r)), key=r.__getitem__) for r in all_.tolist()], int)
    return best, all_[np.arange(len(x)), best]


def _groups(batch: pa.RecordBatch, books: Books):
    """Of a batch of distinct parts: rows, integers and entries of each length and position."""
    length, place = (np.asarray(batch.column(k)) for k in (0, 1))
    for n in np.unique(length).tolist():
        for p in np.unique(place[length == n]).tolist():
            at = np.flatnonzero((length == n) & (place == p))
            entries = books[n][p]
            yield n, p, at, _numbers(batch.column(2).take(pa.array(at)).to_pylist(), entries.shape[1]), entries


def _moved(distinct: DataFrame, books: Books) -> Books:
    """One round: every distinct part to its nearest entry, entries to the mean of theirs, by weight, rounded down."""

    def run(batches):
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            weights = np.asarray(batch.column(3))
            for n, p, at, rows, entries in _groups(batch, books):
                best, w = nearest(rows, entries)[0], weights[at]
                small = (int(abs(rows).max()) if rows.size else 0) * int(w.sum()) < 1 << 62
                rows, w = (rows, w) if small else (rows.astype(object), w.astype(object))
                total, count = sums.setdefault((n, p), [np.zeros(entries.shape, object), np.zeros(len(entries), object)])
                for e in np.unique(best).tolist():
                    total[e] += (rows[best == e] * w[best == e][:, None]).sum(0).astype(object)
                    count[e] += int(w[best == e].sum())
        # the weight goes as the place after the last component
        out = [(n, p, e, k, Decimal(int(x))) for (n, p), (total, count) in sums.items() for e in np.flatnonzero(count) for k, x in enumerate([*total[e], count[e]])]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38)])], ["length", "place", "entry", "k", "total"])

    sent = distinct.mapInArrow(run, "length int, place int, entry int, k int, total decimal(38,0)")
    found: dict[tuple, dict[int, int]] = {}
    for r in sent.groupBy("length", "place", "entry", "k").agg(F.sum("total").alias("total")).collect():  # lengths x all components of a codebook
        found.setdefault((r.length, r.place, r.entry), {})[r.k] = int(r.total)
    new = {n: [b.copy() for b in book] for n, book in books.items()}
    for (n, p, e), sums in found.items():
        width = new[n][p].shape[1]
        new[n][p][e] = [sums[k] // sums[width] for k in range(width)]
    return new


def _coded(distinct: DataFrame, books: Books) -> DataFrame:
    def run(batches):
        for batch in batches:
            codes, errors = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for _, _, at, rows, entries in _groups(batch, books):
                codes[at], errors[at] = nearest(rows, entries)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(codes), pa.array([Decimal(int(x)) for x in errors], pa.decimal128(38))], ["length", "place", "part", "entry", "error"])

    return distinct.mapInArrow(run, "length int, place int, part binary, entry int, error decimal(38,0)")


def _first(kept: DataFrame, length: int, parts: int, entries: int) -> list[np.ndarray]:
    rows = kept.filter(F.col("length") == length).orderBy(F.col("id").asc_nulls_last(), "parts").limit(entries).collect()
    cuts = _cuts(length, parts)
    return [_numbers([bytes(r.parts[p]) for r in rows], cuts[p + 1] - cuts[p]).astype(object) for p in range(parts)]


def train(kept: DataFrame, distinct: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks for each length of vector: entries begin as the parts of the vectors with the smallest ids."""
    books = {r.length: _first(kept, r.length, parts, entries) for r in kept.select("length").distinct().collect()}
    for _ in range(rounds):
        books = _moved(distinct, books)
    return books


def digest(book: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place in the part."""
    return hashlib.sha256(",".join(str(int(x)) for part in book for entry in part for x in entry).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row for each vector without null or non-finite components: id, label, code, error, label_error, codebooks_sha256.

    Each part's code is two hex digits (so `entries` is 256 at most); of equally near entries the first is taken. Rows that repeat an
    id get a row each; among equal ids, and for null ids, which come last, parts decide which vectors are first. Fewer vectors than entries make smaller codebooks. Vectors of different lengths have
    codebooks of their own, which the driver holds; where the parts don't divide a length they differ by one component; an empty vector has error 0.
    Components beyond 1e15 count as the largest integer, 2^62; error and label_error are null where they pass 64 bits. Null
    labels count as one label. Tables without usable vectors give no rows. Other columns are not read, so their names are free.
    """
    spark = vectors.sparkSession
    asked = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kept = written(_whole(asked, scale, parts), "vectors")
    places = kept.select("row", "id", "label", "length", F.posexplode("parts").alias("place", "part"))
    key = ["length", "place", "part"]
    distinct = written(places.groupBy(*key).agg(F.count(F.lit(1)).alias("weight")), "parts")
    books = train(kept, distinct, parts, entries, rounds)
    pieces = places.join(_coded(distinct, books), key).select("row", "id", "label", "length", F.struct("place", "entry").alias("at"), "error")
    digits = F.transform(F.array_sort(F.collect_list("at")), lambda x: F.lpad(F.lower(F.hex(x.entry)), 2, "0"))
    coded = written(pieces.groupBy("row", "id", "label", "length").agg(F.array_join(digits, "").alias("code"), F.sum("error").alias("error")).drop("row"), "codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    hashes = spark.createDataFrame([(n, digest(b)) for n, b in books.items()], "length int, codebooks_sha256 string")
    return (
        coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
        .join(F.broadcast(hashes), "length")
        .select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", *(F.expr(f"try_cast({c} AS bigint)").alias(c) for c in ("error", "label_error")), "codebooks_sha256")
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _round_sql(k: int, last: bool = False) -> str:
    """Parts to entries of round k, and unless it is the last, the entries of the next."""
    near = f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, label, p, v, x, e, d FROM (
    SELECT s.*, c.e, list_sum(list_transform(range(1, len(s.x) + 1), lambda i: (s.x[i] - c.x[i]) * (s.x[i] - c.x[i]))) AS d
    FROM parts s JOIN c{k} c ON s.p = c.p)
  QUALIFY row_number() OVER (PARTITION BY v, p ORDER BY d, e) = 1)"""
    if last:
        return near
    return f"""{near},
m{k} AS (
  SELECT p, e, i, sum(x[i]) AS s, count(*)::HUGEINT AS n FROM a{k}, range(1, 1025) r(i) WHERE i <= len(x) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(g.x, c.x) AS x FROM c{k} c LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{k} GROUP BY ALL) g ON c.p = g.p AND c.e = g.e)"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLES = {
    "op11_vector_codes": f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS v, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::HUGEINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda y: coalesce(isfinite(y), false)))),
parts AS MATERIALIZED (
  SELECT vec_id, label, v, p, list_slice(x, p * len(x) // {PARTS} + 1, (p + 1) * len(x) // {PARTS}) AS x
  FROM kept, range({PARTS}) r(p)),
c0 AS MATERIALIZED (SELECT p, v - 1 AS e, x FROM parts WHERE v <= {ENTRIES}),"""
    + ",".join(_round_sql(k) for k in range(ROUNDS))
    + f""",{_round_sql(ROUNDS, last=True)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY v, vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""
}

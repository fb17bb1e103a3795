"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle of a text is hashed once: the upper bits of its hash name a bin, the rest its value, and a bin keeps the smallest. A bin that got none
takes the value of the first filled one in its own fixed order of all bins, which is the same for all texts; so two texts agree in a bin with the
chance of their sets' Jaccard similarity, whether it was filled or not. The low-order bits of the values, packed, are the fingerprint. Bits of different values
agree by accident in one of 2^bits cases, which the estimate takes off.

Fingerprints need no shuffle. Comparing each document with the next in order needs one: texts are dealt by ranges of the order, each task reads its range in order and hands on one
row at a time, and what stands at the ends of ranges is put together afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._shared import slices, small_batches, text_bytes, written
from ._words import LOWER, WHITE, Words, mix, windows_at, within

#: Words of a shingle; a text of fewer is one shingle.
SHINGLE = 5
#: Bins of a fingerprint, a power of two, and low-order bits of each (1, 2, 4 or 8).
BINS = 512
BITS = 4
_NONE = np.uint64((1 << 64) - 1)


@cache
def orders(bins: int) -> np.ndarray:
    """[step, bin]: where each bin looks for a value at that step. Each column is a permutation, drawn by a fixed rule."""
    keys = mix(np.arange(1, bins * bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(bins, bins)
    return keys.argsort(0, kind="stable")


def densified(values: np.ndarray) -> np.ndarray:
    """Each row with its empty bins filled from others; a row without any value stays empty."""
    values = values.copy()
    empty = values == _NONE
    some = ~empty.all(1)
    row, bin_ = np.nonzero(empty & some[:, None])
    for at in orders(values.shape[1]):
        if not len(row):
            break
        found = ~empty[row, at[bin_]]
        values[row[found], bin_[found]] = values[row[found], at[bin_[found]]]
        row, bin_ = row[~found], bin_[~found]
    return values


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeated ones too, and the text of each."""
    begin, owner = within(words.at, size)
    hashes, owners, n = [windows_at(words.hash, begin, size)], [owner], words.counts()
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        hashes.append(windows_at(words.hash, words.at[:-1][short], k))
        owners.append(short)
    return np.concatenate(hashes), np.concatenate(owners)


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the low-order bits, the first bin's highest."""
    low = (values & np.uint64((1 << bits) - 1)).astype(np.uint8).reshape(len(values), -1, 8 // bits)
    out = np.zeros(low.shape[:2], np.uint8)
    for k in range(8 // bits):
        out |= low[:, :, k] << np.uint8(8 - bits * (k + 1))
    return out


def _prints(column: pa.Array, bins: int, bits: int, size: int) -> list[bytes]:
    """The fingerprint of each text; empty for a text without words."""
    raw, at = text_bytes(column)
    shift, out = np.uint64(64 - bins.bit_length() + 1), []
    for i, j in slices(at):
        hashes, owner = shingle_hashes(Words(LOWER[raw[at[i] : at[j]]], at[i : j + 1] - at[i], WHITE), size)
        values = np.full((j - i) * bins, _NONE)
        np.minimum.at(values, owner * bins + (hashes >> shift).astype(np.int64), hashes & ((np.uint64(1) << shift) - np.uint64(1)))
        values = values.reshape(j - i, bins)
        out += [b.tobytes() if any_ else b"" for b, any_ in zip(packed(densified(values), bits), (values != _NONE).any(1).tolist(), strict=True)]
    return out


def _agreement(a: list[bytes], b: list[bytes], bits: int) -> np.ndarray:
    """Estimated similarities of fingerprints of one kind, pair by pair."""
    out, both = np.zeros(len(a)), np.array([bool(x and y) for x, y in zip(a, b, strict=True)], bool)
    if both.any():
        x, y = (np.frombuffer(b"".join(t for t, use in zip(s, both, strict=True) if use), np.uint8).reshape(both.sum(), -1) for s in (a, b))
        differ = x ^ y
        mask = np.uint8((1 << bits) - 1)
        same = sum(((differ >> np.uint8(bits * k)) & mask == 0).sum(1) for k in range(8 // bits)) / (x.shape[1] * 8 // bits)
        by_chance = 2.0**-bits
        out[both] = np.clip((same - by_chance) / (1 - by_chance), 0, 1)
    out[[x == y for x, y in zip(a, b, strict=True)]] = 1
    return out


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, size: int = SHINGLE) -> Column:
    """The fingerprint of a text: hexadecimal digits, or an empty string where it has no words. Null counts as empty.

    Words are what white space (U+0020, U+0009 to U+000D) parts, with A-Z in lower case; shingles are runs of `size` of them. Equal texts have equal
    fingerprints, in every run and on every machine.
    """
    _known(bins, bits)

    @F.pandas_udf("string")
    def of(texts):
        import pandas as pd

        return pd.Series([p.hex() for p in _prints(pa.Array.from_pandas(texts, type=pa.large_string()), bins, bits, size)])

    return of(F.coalesce(text, F.lit("")))


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """How alike two documents are by their fingerprints, 0 to 1: the estimated Jaccard similarity of their sets of shingles. Equal fingerprints, empty ones too, give 1; an empty one and another 0; null gives null."""

    @F.pandas_udf("double")
    def of(left, right):
        import pandas as pd

        there = left.notna() & right.notna()
        out = pd.Series(np.nan, index=left.index).astype(object)
        out[there] = _agreement(*([bytes.fromhex(x) for x in side[there]] for side in (left, right)), bits)
        return out.where(there, None)

    return of(a, b)


def _known(bins: int, bits: int) -> None:
    if bins & (bins - 1) or bins < 8 or bits not in (1, 2, 4, 8):
        raise ValueError("bins: a power of two from 8 on; bits: 1, 2, 4 or 8")


def edit(text: str, other: str) -> str:
    """The text with its last third replaced by as much of the other's beginning."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


_RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
#: head: a range's first row. tail: its last, whose next one stands elsewhere.
_ENDS = "place int, kind string, text string"


def _compared(ids: pa.Array, texts: list[str], prints: list[bytes], bins: int, bits: int, size: int) -> list[pa.Array]:
    """Columns of the result for all rows but the last, each compared with the next."""
    edited = [edit(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    marks = _prints(pa.array(edited, pa.large_string()), bins, bits, size)
    own = prints[:-1]
    return [
        ids.slice(0, len(edited)),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()),
        pa.array(own, pa.binary()),
        pa.array(marks, pa.binary()),
        pa.array(_agreement(own, marks, bits)),
        pa.array(_agreement(own, prints[1:], bits)),
    ]


def compared_with_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, bins: int = BINS, bits: int = BITS, size: int = SHINGLE
) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike it is to the edited text and to the next document.

    The next document is that with the next smaller id (after the last: the first); rows of one id come in the order of their texts' SHA-256, null ids last; a single
    document's next is itself. In the edited text the last floor(n/3) of n code points are replaced by the next document's first as many, or all it has. Null texts count as empty; a repeated row gets a row. An
    empty table gives no rows. Other columns are not read, so their names are free.

    ranges: into how many parts the order is dealt; spark.sql.shuffle.partitions if not given. Ranges are cut between any two rows, so that no id or text is too frequent.
    """
    _known(bins, bits)
    spark = docs.sparkSession
    small_batches(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # equal rows may stand in any order, as their results are the same; the last key lets them be cut apart
    order = [F.col("id").desc_nulls_last(), F.unhex(F.sha2("text", 256)), F.col("salt")]
    rows = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("id", "text")
    id_type = rows.schema["id"].dataType
    names = ["id", *(c.split()[0] for c in _RESULT.split(", ")), *(c.split()[0] for c in _ENDS.split(", "))]
    schema = StructType([StructField("id", id_type), *StructType.fromDDL(f"{_RESULT}, {_ENDS}").fields])

    def end(place: int, kind: str, key: pa.Array, text: str, print_: bytes) -> pa.RecordBatch:
        nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([key, *nothing, pa.array([print_]), pa.nulls(1, pa.binary()), *[pa.nulls(1, pa.float64())] * 2, pa.array([place], pa.int32()), pa.array([kind]), pa.array([text])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts, prints = batch.column(0), batch.column(1).to_pylist(), _prints(batch.column(1), bins, bits, size)
            if last is None:
                yield end(place, "head", ids.slice(0, 1), texts[0], prints[0])
            else:
                ids, texts, prints = pa.concat_arrays([last[0], ids]), [last[1], *texts], [last[2], *prints]
            found = _compared(ids, texts, prints, bins, bits, size)
            n = len(texts) - 1
            yield pa.RecordBatch.from_arrays([*found, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names)
            last = ids.slice(n, 1), texts[-1], prints[-1]
        if last is not None:
            yield end(place, "tail", *last)

    table = written(rows.mapInArrow(run, schema), "compared")
    ends = table.filter("kind IS NOT NULL")
    places = sorted(r.place for r in ends.filter("kind = 'head'").select("place").collect())  # one a range
    after = spark.createDataFrame(list(zip(places, [*places[1:], *places[:1]], strict=True)), "place int, next int")
    heads = ends.filter("kind = 'head'").select(F.col("place").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    pairs = ends.filter("kind = 'tail'").join(after, "place").join(heads, "next").select("id", "text", "fingerprint", "next_text", "next_print")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, print_, next_text, next_print = (batch.column(c)[k].as_py() for c in range(1, 5))
                yield pa.RecordBatch.from_arrays(_compared(batch.column(0).slice(k, 1), [text, next_text], [print_, next_print], bins, bits, size), names[:7])

    rest = pairs.mapInArrow(join, StructType(schema.fields[:7]))
    digits = lambda c: F.lower(F.hex(c)).alias(c)
    found = table.filter("kind IS NULL").select(*names[:7]).unionByName(rest)
    return found.select(F.col("id").alias(id_col), "n_chars", digits("edited_sha256"), digits("fingerprint"), digits("edited_fingerprint"), "near_edited", "near_next")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_fingerprints": op13_fingerprints}
#: SQL has no such hashes; a test compares with a brute-force version.
ORACLES: dict[str, str] = {}

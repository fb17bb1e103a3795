"""Token ids in binary files: frequency-ranked, byte-aligned, with control bytes apart from the data.

A file holds blocks of whole documents. In a block, each id is replaced by
its rank by frequency there, so that frequent ids take one byte. Two control
bits a rank tell how many bytes it has; four ranks share a control byte. The
reader takes a control byte at a time: tables of 256 entries give how many
data bytes its four ranks have and where each goes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import open_file, scratch, slices, small_batches, text_bytes, written
from ._tokens import encoder

MAGIC = b"QRB1"
#: Ids in a block, but for a document that alone has more.
BLOCK_IDS = 4 << 20
HEAD = struct.Struct("<4sQQQQQ")
#: Control bytes decoded at once.
STEP = 1 << 16

_lengths = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)])
_total = _lengths.sum(1)
_place = np.full((256, 16), -1)
for _c in range(256):
    _at = 0
    for _k in range(4):
        for _b in range(_lengths[_c][_k]):
            _place[_c][4 * _k + _b] = _at
            _at += 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    r = np.zeros(-(-len(ranks) // 4) * 4, np.uint32)
    r[: len(ranks)] = ranks
    size = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    control = (size.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = r.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), data[np.arange(4) <= size[:, None]].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first n ranks."""
    c = np.frombuffer(control, np.uint8)
    d = np.frombuffer(data + b"\0", np.uint8)
    ends = np.cumsum(_total[c])
    out = np.empty((len(c), 16), np.uint8)
    for i in range(0, len(c), STEP):
        part = c[i : i + STEP]
        place = _place[part]
        begin = ends[i : i + STEP] - _total[part]
        out[i : i + STEP] = d[np.where(place < 0, len(d) - 1, begin[:, None] + place)]
    return out.reshape(-1).view("<u4")[:n]


def write_block(out, ids: list[int | None], arrays: list[np.ndarray]) -> int:
    """Append one block; the bytes written."""
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    counts = np.bincount(flat, minlength=1)
    table = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank = np.zeros(len(counts), np.uint32)
    rank[table] = np.arange(len(table))
    control, data = pack_ranks(rank[flat])
    parts = [
        np.array([x is not None for x in ids], np.uint8).tobytes(),
        np.array([x or 0 for x in ids], "<i8").tobytes(),
        np.array([len(a) for a in arrays], "<i8").tobytes(),
        table.astype("<u4").tobytes(),
        control,
        data,
    ]
    head = HEAD.pack(MAGIC, len(ids), len(flat), len(table), len(control), len(data))
    body = b"".join(parts)
    out.write(head + struct.pack("<I", zlib.crc32(body)))
    out.write(body)
    return HEAD.size + 4 + len(body)


def read_blocks(source) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, tokens of each, all their token ids) block by block."""
    while head := source.read(HEAD.size + 4):
        magic, docs, n, ranks, control, data = HEAD.unpack(head[: HEAD.size])
        body = source.read(17 * docs + 4 * ranks + control + data)
        if magic != MAGIC or struct.unpack("<I", head[HEAD.size :])[0] != zlib.crc32(body):
            raise ValueError("damaged block")
        valid = np.frombuffer(body, np.uint8, docs)
        names = np.frombuffer(body, "<i8", docs, docs)
        sizes = np.frombuffer(body, "<i8", docs, 9 * docs)
        table = np.frombuffer(body, "<u4", ranks, 17 * docs)
        at = 17 * docs + 4 * ranks
        flat = table[unpack_ranks(body[at : at + control], body[at + control :], n)] if n else np.zeros(0, np.uint32)
        yield [int(x) if v else None for x, v in zip(names, valid)], sizes, flat


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write files in ascending order of id; one row per file: part, path, n_docs, n_ids.

    Files are named once per attempt, and the returned table, which is written, names
    those of attempts that ended well; so what a lost task left is never read. Rows
    of one id stand together, ordered by a hash of the text; null ids come first. Null texts are empty and have the
    end id only. An empty table gives no files.
    """
    small_batches(docs.sparkSession)

    def write(batches):
        from pyspark import TaskContext

        path, out, enc = f"{folder}/{uuid.uuid4().hex}.qrb", None, encoder(tokenizer_path)
        names, arrays, held, n_docs, n_ids = [], [], 0, 0, 0
        end = np.array([end_id], enc.type)
        for batch in batches:
            ids, text = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            _, at = text_bytes(text)
            for i, j in slices(at):
                for name, a in zip(ids[i:j], enc.encode(text.slice(i, j - i).to_pylist())):
                    names.append(name)
                    arrays.append(np.concatenate([a, end]))
                    held += len(a) + 1
                    if held >= block_ids:
                        out = out or open_file(path, True)
                        write_block(out, names, arrays)
                        n_docs, n_ids, names, arrays, held = n_docs + len(names), n_ids + held, [], [], 0
        if names:
            out = out or open_file(path, True)
            write_block(out, names, arrays)
            n_docs, n_ids = n_docs + len(names), n_ids + held
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # rows of one id, null ids among them, may be many: by a further key they can stand in several files
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    return written(ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "token-files")


def read_tokens(spark: SparkSession, files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From the files, one row per document: id, start, n_tokens, ids_crc32.

    The rows of `files`, one a file, are few; their number is that of the writing tasks.
    """
    found, at = [], 0
    for f in files.orderBy("part").collect():
        found.append((f.path, at))
        at += f.n_ids
    kind = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long"
    if not found:
        return spark.createDataFrame([], kind)

    named = spark.sparkContext.broadcast(found)

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                path, begin = named.value[k]
                with open_file(path) as source:
                    for names, sizes, flat in read_blocks(source):
                        ends = np.cumsum(sizes)
                        crcs = [zlib.crc32(flat[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(begin + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])
                        begin += int(ends[-1]) if len(ends) else 0

    return spark.range(0, len(found), 1, len(found)).mapInArrow(read, kind)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of all documents and read them back (write_tokens, read_tokens)."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, folder or scratch(spark, "tokens"), tokenizer_path, end_id, id_col, text_col), id_col)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2)


QUERIES = {"op6_token_output": op6_token_output}
ORACLES: dict = {}

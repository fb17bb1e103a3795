"""Packing of documents into sequences of several lengths.

Each scan task packs its own documents and moves none. Of a document, whole
windows of the longest length are cut off; what remains goes to the tier of the
shortest window that holds it. From the longest tier to the shortest, a window begins with the longest remainder of
its tier, and its gap is filled with the longest remainders that fit, those of
shorter tiers included; a gap that nothing fits takes the head of the shortest longer one. So
only the last sequence of a task can be left with a gap. Full windows of a tier are
dealt into step groups that hold equally many tokens.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import slices, small_batches, text_bytes
from ._tokens import encoder

#: Context sizes, all powers of two.
TIERS = (256, 512, 1024, 2048)
#: Tokens in a step group.
GROUP_TOKENS = 16 * 2048
#: Remainders that wait in a task before they are packed.
POOL = 4096
#: Sequences of a task at most, as a shift of the task's number.
SHIFT = 36


class Packer:
    """add(document, ids) and finish() give pieces: (document, start, ids, doc_tokens, sequence, offset, tier, step_group)."""

    def __init__(self, tiers=TIERS, pool: int = POOL, group_tokens: int = GROUP_TOKENS, first: int = 0):
        self.tiers, self.pool, self.group_tokens = sorted(tiers), pool, group_tokens
        self.longest = self.tiers[-1]
        self.next, self.first, self.order = first, first, 0
        self.wait: dict[int, list] = {t: [] for t in self.tiers}  # of (length, order, document, start, ids, doc_tokens), by length
        self.open: dict[int, list] = {}
        self.group = 0

    def _put(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.order += 1
        insort(self.wait[next(t for t in self.tiers if t >= len(ids))], (len(ids), self.order, doc, start, ids, total))

    def _emit(self, parts: list, tier: int) -> Iterator[tuple]:
        group = self.open.get(tier)
        if group is None:
            group = self.open[tier] = [self.first + self.group, 0]
            self.group += 1
        at = 0
        for _, _, doc, start, ids, total in parts:
            yield doc, start, ids, total, self.next, at, tier, group[0]
            at += len(ids)
        self.next += 1
        group[1] += tier
        if group[1] >= self.group_tokens:
            del self.open[tier]

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) - len(ids) % self.longest
        for k in range(0, whole, self.longest):
            yield from self._emit([(self.longest, 0, doc, k, ids[k : k + self.longest], len(ids))], self.longest)
        if whole < len(ids):
            self._put(doc, whole, ids[whole:], len(ids))
        if sum(map(len, self.wait.values())) >= self.pool:
            yield from self._pack(False)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(True)

    def _fitting(self, gap: int, most: int):
        """The longest remainder of at most this gap."""
        for t in reversed(self.tiers):
            if t <= most and self.wait[t] and self.wait[t][0][0] <= gap:
                return self.wait[t].pop(bisect_right(self.wait[t], gap, key=lambda x: x[0]) - 1)
        return None

    def _pack(self, last: bool) -> Iterator[tuple]:
        left: list = []
        for tier in reversed(self.tiers):
            while self.wait[tier]:
                window = [self.wait[tier].pop()]
                gap = tier - window[0][0]
                while gap:
                    x = self._fitting(gap, tier)
                    if x is None:
                        longer = next((t for t in self.tiers if self.wait[t]), None)
                        if longer is None or longer > tier:
                            break
                        n, order, doc, start, ids, total = self.wait[longer].pop(0)
                        x = (gap, order, doc, start, ids[:gap], total)
                        self._put(doc, start + gap, ids[gap:], total)
                    window.append(x)
                    gap -= len(x[4])
                if gap and not last:
                    left += window
                else:
                    yield from self._emit(window, tier)
        for n, _, doc, start, ids, total in left:
            self._put(doc, start, ids, total)


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, tiers=TIERS, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A sequence is full at its tier's length, but for the last of a task, which may be shorter. A null text counts as
    empty; an empty text has one token, the end id. Rows that repeat an id are documents of their own, each with all its
    pieces. An empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        enc, packer = encoder(tokenizer_path), Packer(tiers, pool, first=TaskContext.get().partitionId() << SHIFT)
        end, out = np.array([end_id], enc.type), []

        def batch_of(rows):
            cols = list(zip(*rows))
            sizes = [len(x) for x in cols[2]]
            crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in cols[2]]
            arrays = [pa.array(x, pa.int64()) for x in (cols[0], cols[1], sizes, crcs, *cols[3:6])]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(cols[6], pa.int32()), pa.array(cols[7], pa.int64())], names)

        for batch in batches:
            ids, text = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            _, at = text_bytes(text)
            for i, j in slices(at):
                for name, a in zip(ids[i:j], enc.encode(text.slice(i, j - i).to_pylist())):
                    out.extend(packer.add(name, np.concatenate([a, end])))
                if len(out) > 5000:
                    yield batch_of(out)
                    out = []
        out.extend(packer.finish())
        if out:
            yield batch_of(out)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    kind = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, kind)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 1)


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict = {}

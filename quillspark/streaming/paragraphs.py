"""Documents that arrive paragraph by paragraph: what looks back or ahead is kept as state of each document.

A paragraph needs the one before it, a list of references holds to the document's end, and a sentence's zone depends on its neighbours. Of each document the state has the last paragraph, the latch, the zone of the sentence before
and the one sentence that waits for the next. So results are those of the batch operators, however a document is cut into micro-batches, and after a restart.

Paragraphs of a document come in order; within a micro-batch they may stand in any. A document is closed by a paragraph that is marked as its last, or when nothing has come for `idle`; what comes
later begins it anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.packs import LATIN, Pack
from ..operators import dimensions, sentences
from ..operators.sentences import spread_step

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Closing(StatefulProcessor):
    """State of a document that a last row or a timer ends."""

    def __init__(self, idle: int):
        self.idle = idle

    def _expect(self, timers) -> None:
        """One timer a document, moved on by whatever comes."""
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + 1000 * self.idle)

    def _forget(self) -> None:
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)

    def close(self) -> None:
        pass


class _Previous(_Closing):
    """Adds the paragraph before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.text = handle, handle.getValueState("text", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("p_idx", kind="stable")
        before = self.text.get()[0] if self.text.exists() else ""
        own["prev"] = [before, *own["text"].tolist()[:-1]]
        if own["last"].any():
            self.text.clear()
            self._forget()
        else:
            self.text.update((own["text"].iloc[-1],))
            self._expect(timerValues)
        yield own[["doc_id", "p_idx", "text", "prev"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.text.clear()
        yield pd.DataFrame({"doc_id": [], "p_idx": [], "text": [], "prev": []})


_COLUMNS = ["p_idx", "s_idx", "chars", "score", "zone"]


class _Spread(_Closing):
    """The latch of references, and the spread of zones with one sentence held back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "latched boolean, before string, waits boolean, p_idx int, s_idx int, chars int, score double, zone string")

    def _out(self, key, rows: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["doc_id", *_COLUMNS])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["p_idx", "s_idx"], kind="stable")
        latched, before, waits, *row = self.kept.get() if self.kept.exists() else (False, None, False, *[None] * 5)
        done = []
        for r in own.itertuples(index=False):
            if r.s_idx < 0:  # a paragraph begins
                latched = latched or bool(r.starts)
                continue
            now = [int(r.p_idx), int(r.s_idx), int(r.chars), 0.0 if latched else float(r.score), "green" if latched else r.zone]
            if waits:
                before, score = spread_step(before, row[4], row[3], now[4])
                done.append([*row[:3], score, before])
            row, waits = now, True
        if own["last"].any():
            if waits:
                zone, score = spread_step(before, row[4], row[3], None)
                done.append([*row[:3], score, zone])
            self.kept.clear()
            self._forget()
        else:
            self.kept.update((latched, before, waits, *row))
            self._expect(timerValues)
        yield self._out(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = []
        if self.kept.exists():
            _, before, waits, *row = self.kept.get()
            if waits:
                zone, score = spread_step(before, row[4], row[3], None)
                done.append([*row[:3], score, zone])
            self.kept.clear()
        yield self._out(key, done)


def _stateful(rows: DataFrame, processor: _Closing, schema: StructType) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return rows.groupBy("doc_id").transformWithStateInPandas(processor, schema, "append", "ProcessingTime" if processor.idle else "None")


def previous(paragraphs: DataFrame, idle: int = 0) -> DataFrame:
    """doc_id, p_idx, text, prev ('' for the first), from a stream of doc_id, p_idx, text, last. idle: seconds after which a document is closed; 0 for never."""
    schema = StructType([paragraphs.schema["doc_id"], StructField("p_idx", IntegerType()), StructField("text", StringType()), StructField("prev", StringType())])
    return _stateful(paragraphs.select("doc_id", F.col("p_idx").cast("int").alias("p_idx"), "text", "last"), _Previous(idle), schema)


def levels(paragraphs: DataFrame, pack: Pack = LATIN, idle: int = 0) -> DataFrame:
    """doc_id, p_idx, ai_count, level, comprehensive_score of each paragraph, as dimensions.scanned() gives them: the likeness to the paragraph before is one of the statistics."""
    return dimensions.scanned(previous(paragraphs, idle), pack).select("doc_id", "p_idx", "ai_count", "level", "comprehensive_score")


def zones(paragraphs: DataFrame, pack: Pack = LATIN, idle: int = 0, model=None) -> DataFrame:
    """doc_id, p_idx, s_idx, chars, score, zone of each sentence, after the latch and the spread, as sentences.propagated(sentences.zones_raw()) gives them; a document's last sentence comes when it is closed."""
    par = paragraphs.select("doc_id", F.col("p_idx").cast("int").alias("p_idx"), "text", "last")
    rows = sentences.zones_raw(par, pack, model=model, latch=False).select("doc_id", "p_idx", "s_idx", "chars", "score", "zone", "starts", "last")
    schema = StructType([paragraphs.schema["doc_id"], *(StructField(c, t) for c, t in zip(_COLUMNS, (IntegerType(), IntegerType(), IntegerType(), DoubleType(), StringType()), strict=True))])
    return _stateful(rows, _Spread(idle), schema)


def turns(messages: DataFrame, ends: DataFrame, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """doc_id, p_idx, text, last from a stream of messages; ends: the id and the number (a column end) of each conversation's last one."""
    rows = messages.select(F.col(id_col).alias("doc_id"), F.col(order_col).cast("int").alias("p_idx"), F.col(text_col).alias("text"))
    return rows.join(ends.select(F.col(id_col).alias("doc_id"), "end"), "doc_id", "left").select("doc_id", "p_idx", "text", F.coalesce(F.col("p_idx") == F.col("end"), F.lit(False)).alias("last"))

"""The library in SQL: table functions, and views of a scan.

    tables.register(spark)
    SELECT d.doc_id, p.* FROM documents d, LATERAL split_paragraphs(d.text)
    SELECT d.doc_id, s.* FROM documents d, LATERAL split_paragraphs(d.text, 'zh', true) s
    SELECT * FROM spread_zones(TABLE(SELECT * FROM sentences))
    SELECT * FROM reference_latch(TABLE(paragraphs), 'latin')

    tables.views(spark, docs)
    SELECT * FROM paragraphs / sentences / diagnosis / fused / doc_summary
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructType

from .functions.packs import LATIN, ZH, Pack
from .operators import dimensions, fusion, parse, sentences
from .operators.kernels import STRIPPED, Kernel

PACKS = {p.name: p for p in (ZH, LATIN)}


def _pack(argument: AnalyzeArgument | None) -> str:
    name = "latin" if argument is None else argument.value
    if name not in PACKS:
        raise ValueError(f"pack must be one of {', '.join(sorted(PACKS))}, as a constant")
    return name


class SplitParagraphs:
    """split_paragraphs(text [, pack [, sentences]]): p_idx, text, prev of each paragraph; with sentences, p_idx, s_idx, sentence, chars. A null text gives no rows."""

    @staticmethod
    def analyze(text: AnalyzeArgument, pack: AnalyzeArgument | None = None, cut: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.isTable or not isinstance(text.dataType, StringType):
            raise ValueError("split_paragraphs takes a text")
        _pack(pack)
        if cut is not None and not isinstance(cut.value, bool):
            raise ValueError("the third argument of split_paragraphs is true or false")
        if cut is not None and cut.value:
            return AnalyzeResult(StructType().add("p_idx", IntegerType()).add("s_idx", IntegerType()).add("sentence", StringType()).add("chars", IntegerType()))
        return AnalyzeResult(StructType().add("p_idx", IntegerType()).add("text", StringType()).add("prev", StringType()))

    def eval(self, text: str | None, pack: str = "latin", cut: bool = False):
        if text is None:
            return
        own = PACKS[pack]
        parts = [s for x in re.split(own.paragraph, text, flags=re.ASCII) if len(s := x.strip(STRIPPED)) > own.least_paragraph]
        for p, (part, before) in enumerate(zip(parts, ["", *parts], strict=False)):
            if not cut:
                yield p, part, before
                continue
            found = [s for x in re.split(own.sentence, part) if len(s := x.strip(STRIPPED)) > own.least_sentence]
            for k, s in enumerate(found):
                yield p, k, s, len(s)


def _needs(rows: AnalyzeArgument, name: str, columns: dict) -> None:
    have = {f.name: f.dataType for f in rows.dataType.fields} if rows.isTable else {}
    missing = [c for c, kind in columns.items() if c not in have or not isinstance(have[c], kind)]
    if missing:
        raise ValueError(f"{name} takes a table with {', '.join(columns)}; {', '.join(missing)} is missing or of another type")


class SpreadZones:
    """spread_zones(TABLE(...)): the rows with zone and score after zones have spread from sentence to sentence, in each doc_id by p_idx, s_idx.

    The engine deals the rows out by document and puts them in order; three rows are in memory at a time.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        _needs(rows, "spread_zones", {"doc_id": object, "p_idx": object, "s_idx": object, "zone": StringType, "score": DoubleType})
        return AnalyzeResult(rows.dataType, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("p_idx"), OrderingColumn("s_idx")])

    def __init__(self):
        self.before, self.row = None, None  # the zone before, as it has become; and the row that waits for the next one

    def _done(self, after: str | None):
        row = self.row
        zone, score = sentences.spread_step(self.before, row["zone"], row["score"], after)
        self.before = zone
        return tuple(zone if name == "zone" else score if name == "score" else row[name] for name in row.__fields__)

    def eval(self, rows):
        if self.row is not None:
            yield self._done(rows["zone"])
        self.row = rows

    def terminate(self):
        if self.row is not None:
            yield self._done(None)


class ReferenceLatch:
    """reference_latch(TABLE(...) [, pack]): the rows with in_references, true from the first paragraph of a document on that begins a list of references."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, pack: AnalyzeArgument | None = None) -> AnalyzeResult:
        _needs(rows, "reference_latch", {"doc_id": object, "p_idx": object, "text": StringType})
        _pack(pack)
        return AnalyzeResult(StructType(rows.dataType.fields).add("in_references", BooleanType()), partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("p_idx")])

    def __init__(self):
        self.inside = False

    def eval(self, rows, pack: str = "latin"):
        self.inside = self.inside or bool(re.match(PACKS[pack].references, (rows["text"] or "").strip(STRIPPED), re.ASCII))
        yield (*rows, self.inside)


class ParagraphDimensions:
    """paragraph_dimensions(text [, prev [, pack]]): dim, value of the twelve statistics."""

    @staticmethod
    def analyze(text: AnalyzeArgument, prev: AnalyzeArgument | None = None, pack: AnalyzeArgument | None = None) -> AnalyzeResult:
        _pack(pack)
        return AnalyzeResult(StructType().add("dim", StringType()).add("dim_ord", IntegerType()).add("value", DoubleType()))

    def __init__(self):
        self.kernels = {}

    def eval(self, text: str | None, prev: str | None = None, pack: str = "latin"):
        if pack not in self.kernels:
            self.kernels[pack] = Kernel(PACKS[pack])
        for k, (d, v) in enumerate(zip(dimensions.RULE_DIMENSIONS, self.kernels[pack].values(text, prev), strict=True)):
            yield d[0], k, v


FUNCTIONS = {"split_paragraphs": SplitParagraphs, "spread_zones": SpreadZones, "reference_latch": ReferenceLatch, "paragraph_dimensions": ParagraphDimensions}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session."""
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(cls))


def views(spark: SparkSession, docs: DataFrame, pack: Pack = LATIN, id_col: str = "doc_id", text_col: str = "text", make=None, prefix: str = "") -> dict[str, DataFrame]:
    """The scan of documents as temporary views: paragraphs, sentences (with zones before they spread), diagnosis (statistics and levels), fused and doc_summary. Nothing runs before a view is read, and
    each reads no more than it needs. `make` gives an encoder; see semantic.encoded."""
    par = parse.paragraphs(docs, pack, id_col, text_col)
    zones = sentences.zones_raw(par, pack)
    levels = dimensions.scanned(par, pack)
    found = {
        "paragraphs": par,
        "sentences": zones,
        "diagnosis": levels,
        "fused": fusion.together(par, pack, make).drop("text", "gaps"),
        "doc_summary": sentences.document_summary(sentences.propagated(zones)),
    }
    for name, df in found.items():
        df.createOrReplaceTempView(prefix + name)
    return found

"""Sinks: JSON and HTML reports, and a plain one for the terminal."""

from __future__ import annotations

import html
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nearest
from ..operators.dimensions import listed
from . import files

LABELS = {"deep_red": "重度AI", "red": "疑似AI", "yellow": "轻微AI", "green": "正常"}
COLOURS = {"deep_red": "#b00020", "red": "#e53935", "yellow": "#f9a825", "green": "#2e7d32"}


def report_summary(levels: DataFrame) -> DataFrame:
    """One row: paragraphs in all, and those of high risk, suspicious and safe."""
    of = lambda *z: F.count_if(F.col("level").isin(*z))
    return levels.agg(F.count(F.lit(1)).alias("total_paragraphs"), of("red", "deep_red").alias("high_risk"), of("yellow").alias("suspicious"), of("green").alias("safe"))


def json_rows(dims: DataFrame, preview: int = 200, rewrites: DataFrame | None = None) -> DataFrame:
    """doc_id, p_idx, json: an object for each paragraph of a rule scan, with preview, level, score, ranked gaps and, where there is one, its rewrite (doc_id, p_idx, rewrite). The gaps come from the row itself."""
    item = lambda x: F.struct((-x.gap).alias("k"), x.dim_ord.alias("o"), F.struct(x.dim.alias("dimension"), x.gap.alias("gap"), x.zone.alias("zone")).alias("x"))
    ranked = F.transform(F.array_sort(F.transform(F.filter("_listed", lambda x: x.zone == "ai"), item)), lambda x: x.x)
    rows = dims.withColumn("_listed", listed())
    # numbers are written apart from the text, as the engine gives those under a thousandth exponents
    plain = lambda c: F.regexp_replace(nearest(c, 4).cast("decimal(18,4)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    gap = lambda x: F.concat(F.lit('{"dimension":"'), x.dimension, F.lit('","gap":'), plain(x.gap), F.lit(',"zone":"'), x.zone, F.lit('"}'))
    opened = lambda *columns: F.regexp_replace(F.to_json(F.struct(*columns)), r"\}$", "")
    head = opened(F.col("p_idx").alias("index"), F.left("text", F.lit(preview)).alias("text_preview"), "level")
    body = [head, F.lit(',"comprehensive_score":'), plain(F.col("comprehensive_score")), F.lit(',"ranked_gaps":['), F.array_join(F.transform(ranked, gap), ","), F.lit("]")]
    if rewrites is not None:
        rows = rows.join(rewrites.select("doc_id", "p_idx", "rewrite"), ["doc_id", "p_idx"], "left")
        body.append(F.when(F.col("rewrite").isNotNull(), F.concat(F.lit(","), F.substring(opened("rewrite"), 2, 2**31 - 1))).otherwise(""))
    return rows.select("doc_id", "p_idx", F.concat(*body, F.lit("}")).alias("json"))


def document_json(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """doc_id, json: one object for each document, with the counts of its summary and the paragraphs' objects of json_rows() in order."""
    of = lambda *z: F.count_if(F.col("level").isin(*z))
    counts = levels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), of("red", "deep_red").alias("high_risk"), of("yellow").alias("suspicious"), of("green").alias("safe"))
    parts = rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_idx", "json"))), lambda x: x["json"]).alias("parts"))
    summary = F.to_json(F.struct(F.col("total").alias("total_paragraphs"), "high_risk", "suspicious", "safe"))
    return counts.join(parts, "doc_id").select("doc_id", F.concat(F.lit('{"summary":'), summary, F.lit(',"paragraphs":['), F.array_join("parts", ","), F.lit("]}")).alias("json"))


def fused_json(rows: DataFrame) -> DataFrame:
    """doc_id, p_idx, json: an object for each paragraph of fusion.together(), with its counts, scores, levels and the gaps of both layers in order. Numbers have up to six places and no exponents."""
    plain = lambda c: nearest(c, 6).cast("decimal(18,6)")
    bare = lambda x: F.struct(x.dim.alias("dimension"), x.description.alias("description"), plain(x.value).alias("value"), plain(x.gap).alias("gap"), x.layer.alias("layer"))
    scores = [plain(nearest(F.col(k), 4)).alias(k) for k in ("rule_score", "combined_score")]
    body = F.struct(F.col("p_idx").alias("paragraph_index"), "rule_level", "rule_ai_count", "rule_gray_count", "semantic_ai_count", "total_dimensions", "combined_ai_count", *scores, "fused_level", F.transform("gaps", bare).alias("gaps"))
    # zeros at the end go; the object has no text of a document in which such a number could stand
    return rows.select("doc_id", "p_idx", F.regexp_replace(F.to_json(body), r"(:-?[0-9]+\.[0-9]+?)0+(?=[,}])", "$1").alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    """One object a line, written by tasks with a manifest; see files.py."""
    files.register(rows.sparkSession)
    rows.select(F.col("json").alias("text")).write.format("textfiles").option("extension", ".json").mode("overwrite").save(path)


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def html_documents(levels: DataFrame, title: str = "Report") -> DataFrame:
    """doc_id, html: a page for each document, with its paragraphs in order. Texts are escaped."""
    label, colour = (F.create_map(*(F.lit(x) for pair in m.items() for x in pair))[F.col("level")] for m in (LABELS, COLOURS))
    section = F.concat(
        F.lit("<section style='border-left:4px solid "), colour, F.lit("'><h2>"), F.col("p_idx").cast("string"), F.lit(": "), label, F.lit(" ("), F.format_string("%.4f", F.round("comprehensive_score", 4)), F.lit(")</h2><p>"),
        _escaped(F.col("text")), F.lit("</p></section>"),
    )
    own = levels.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_idx", section.alias("s")))), lambda x: x["s"]).alias("s"))
    name = html.escape(title)
    head = F.concat(F.lit(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{name}</title></head><body><h1>{name} "), _escaped(F.col("doc_id").cast("string")), F.lit("</h1>"))
    return own.select("doc_id", F.concat(head, F.array_join("s", "\n"), F.lit("</body></html>")).alias("html"))


def write_html(levels: DataFrame, path: str, title: str = "Report") -> None:
    """A file for each document, written by tasks with a manifest; see files.py."""
    files.register(levels.sparkSession)
    pages = html_documents(levels, title).select(F.col("doc_id").cast("string").alias("name"), F.col("html").alias("text"))
    pages.write.format("textfiles").option("extension", ".html").mode("overwrite").save(path)


def html_report(levels: DataFrame, title: str = "Report") -> Iterator[str]:
    """The page piece by piece; paragraphs come one at a time, in order, so the driver never holds them all. Texts are escaped."""
    yield f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>\n"
    for r in levels.orderBy("doc_id", "p_idx").select("doc_id", "p_idx", "text", "level", F.round("comprehensive_score", 4).alias("score")).toLocalIterator():
        yield f"<section style='border-left:4px solid {COLOURS[r.level]}'><h2>{r.doc_id} / {r.p_idx}: {LABELS[r.level]} ({r.score})</h2><p>{html.escape(r.text)}</p></section>\n"
    yield "</body></html>\n"


def terminal_report(levels: DataFrame) -> Iterator[str]:
    """A line for each level with its count and share."""
    rows = levels.groupBy("level").count().collect()
    total = sum(r["count"] for r in rows) or 1
    for r in sorted(rows, key=lambda r: list(LABELS).index(r.level)):
        yield f"{LABELS[r.level]}\t{r['count']}\t{100 * r['count'] / total:.1f}%"


def rewrite_prompt(zones: DataFrame) -> DataFrame:
    """doc_id, p_idx, prompt: the sentences of a paragraph that are not green, each with its zone, in order."""
    line = F.concat(F.lit("["), "zone", F.lit("] "), "sentence")
    own = zones.filter("zone <> 'green'").groupBy("doc_id", "p_idx").agg(F.sort_array(F.collect_list(F.struct("s_idx", line.alias("line")))).alias("s"))
    return own.select("doc_id", "p_idx", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("prompt"))


def nested_report(zones: DataFrame, fused: DataFrame) -> DataFrame:
    """doc_id, p_idx, level, score, ai_sentence_count, total_sentence_count, sentences: each paragraph with its sentences nested in order."""
    own = zones.groupBy("doc_id", "p_idx").agg(F.count_if(F.col("zone").isin("red", "orange")).alias("n"), F.sort_array(F.collect_list(F.struct("s_idx", "sentence", "zone", F.round("score", 4).alias("score")))).alias("sentences"))
    rows = fused.join(own, ["doc_id", "p_idx"], "left")
    return rows.select(
        "doc_id", "p_idx", F.col("fused_level").alias("level"), F.round(100 * F.col("combined_score")).cast("int").alias("score"), F.coalesce("n", F.lit(0)).alias("ai_sentence_count"),
        F.when(F.col("n").isNull(), 0).otherwise(F.size("sentences")).alias("total_sentence_count"), "sentences",
    )


#: What levels are called in the fused terminal report.
FUSED_LABELS = {"green": "SAFE", "yellow": "SUSPICIOUS", "red": "HIGH RISK", "deep_red": "AI CONFIRMED"}


def fused_report(fused: DataFrame, par: DataFrame, told: DataFrame, most: int = 3, preview: int = 120) -> Iterator[str]:
    """Lines for the terminal, a paragraph at a time in order: level, score, counts, preview, and the first instructions of those that are not green."""
    first = told.filter(F.col("rank") <= most).groupBy("doc_id", "p_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "instruction"))), lambda x: x["instruction"]).alias("told"))
    rows = fused.join(par.select("doc_id", "p_idx", F.left("text", F.lit(preview)).alias("preview")), ["doc_id", "p_idx"]).join(first, ["doc_id", "p_idx"], "left")
    for r in rows.orderBy("doc_id", "p_idx").toLocalIterator():
        yield f"{r.doc_id} #{r.p_idx + 1} {FUSED_LABELS[r.fused_level]}  score {100 * r.combined_score:.0f}%, rules {r.rule_ai_count}, vectors {r.semantic_ai_count}"
        yield f"  {r.preview}"
        if r.fused_level != "green":
            yield from (f"    {k}. {x}" for k, x in enumerate(r.told or [], 1))


#: Characters that a text to be scanned must have at least.
LEAST_TEXT = 20


def refusals(docs: DataFrame, par: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, error: why a document is not scanned; null for those that are."""
    some = par.select("doc_id").distinct().withColumn("_has", F.lit(True))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))).alias("_n")).join(some, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("_n") < LEAST_TEXT, "文本太短").when(F.col("_has").isNull(), "未检测到有效段落").alias("error"))

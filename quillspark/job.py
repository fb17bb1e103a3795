"""A scan as a batch job: spark-submit quillspark/job.py SOURCE [--format terminal|json|html|rates] [--output PATH] [--pack zh|latin] [--no-embedding] [--model PATH] [--dictionary PATH].

With rates, each document's share of suspect characters by its sentences; --model names a saved detector (operators/scoring.py) that then decides. --dictionary names files of words and frequencies.

SOURCE is a path of text or docx files (patterns are allowed), or a text. With --status, what this installation can do.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.packs import LATIN, ZH, with_frequencies
from quillspark.operators import dimensions, fusion, lexicons, parse, scoring, sentences
from quillspark.sources import readers, sinks


def status() -> dict:
    """What can be used here."""
    return {"rules": True, "embedding": "lexical", "docx": True, "formats": ["terminal", "json", "html", "rates"], "packs": ["zh", "latin"]}


def scan(docs: DataFrame, pack, embedding: bool = True, make=None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Paragraphs, rule levels, fused levels and the gap report of documents (doc_id, text). `make` gives an encoder; see operators/semantic.py."""
    par = parse.paragraphs(docs, pack)
    rows = fusion.together(par, pack, make, embedding)
    return par, dimensions.scanned(par, pack), rows, fusion.gap_report(rows)


def rates(docs: DataFrame, pack, model=None) -> DataFrame:
    """The summary of each document (doc_id, text) that has sentences, with ai_rate to four places and its verdict."""
    zones = sentences.propagated(sentences.zones_raw(parse.paragraphs(docs, pack), pack, model=model))
    out = sentences.document_summary(zones).withColumn("ai_rate", F.round("ai_rate", 4))
    return out.withColumn("verdict", sentences.verdict(F.col("ai_rate")))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(description="Scan texts for machine-generated style.")
    p.add_argument("source", nargs="?")
    p.add_argument("--format", choices=("terminal", "json", "html", "rates"), default="terminal")
    p.add_argument("--model")
    p.add_argument("--dictionary")
    p.add_argument("--output")
    p.add_argument("--pack", choices=("zh", "latin"), default="zh")
    p.add_argument("--embedding", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--status", action="store_true")
    a = p.parse_args(arguments)
    if a.status:
        print(json.dumps(status()))
        return 0
    if not a.source:
        p.error("a source is needed")
    spark = spark or SparkSession.builder.appName("scan").getOrCreate()
    pack = ZH if a.pack == "zh" else LATIN
    if a.dictionary:
        pack = with_frequencies(pack, lexicons.frequencies(readers.dictionary(spark, a.dictionary)))
    docs = readers.documents_from(spark, a.source).select(F.col("path").alias("doc_id"), "text")
    if a.format == "rates":
        rows = rates(docs, pack, scoring.Detector.load(a.model) if a.model else None).orderBy("doc_id")
        if a.output:
            rows.write.mode("overwrite").json(a.output)
        else:
            for line in rows.toJSON().toLocalIterator():
                print(line)
        return 0
    par, levels, fused, gaps = scan(docs, pack, a.embedding)
    if par.isEmpty():
        print("no valid paragraphs", file=sys.stderr)
        return 1
    if a.format == "json":
        rows = sinks.fused_json(fused)
        if a.output:
            sinks.write_json(rows, a.output)
        else:
            for r in rows.orderBy("doc_id", "p_idx").toLocalIterator():
                print(r.json)
    elif a.format == "html" and a.output:
        sinks.write_html(levels, a.output)
    else:
        pieces = sinks.html_report(levels) if a.format == "html" else (line + "\n" for line in sinks.fused_report(fused, par, fusion.instructions(spark, gaps)))
        out = open(a.output, "w", encoding="utf-8") if a.output else sys.stdout
        try:
            out.writelines(pieces)
        finally:
            if a.output:
                out.close()
    n, high = fused.agg(F.count(F.lit(1)), F.count_if(F.col("fused_level").isin("red", "deep_red"))).first()
    print(f"{high} of {n} paragraphs are of high risk", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

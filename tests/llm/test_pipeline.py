"""Each stage of the pipeline against brute force on what the stage before it kept."""

import hashlib
import re

import corpus_pipeline as c
import test_decontaminate as td
import test_exact_dedup as te
import test_near_dedup as tn
import test_tokens as tt
from pyspark.sql import functions as F

from quillspark.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (None, "one two three", "en", "s", 13), (10**6 + 2, None, None, None, None)]
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    extra += [(10**6 + 4, "Twice the same  text", "en", "s", 9), (10**6 + 4, "Twice the sametext", "en", "s", 9), (None, "Twice the same text", "en", "s", 9), (None, "one two th ree", "en", "s", 9)]
    extra += [(None, f"so {passage} it is", "en", "s", 9), (10**6 + 3, "clean words under an id", "en", "s", 9), (10**6 + 3, f"other {passage} words", "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("kept", F.lit("own")).repartition(4)
    assert [k for k, _ in c.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(c.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            tt.check_pieces(after.collect(), before, tt.plain("byte_bpe_50k.json"))
            break
        assert after.columns == docs.columns
        kept = sorted(((r.doc_id, r.text) for r in after.select("doc_id", "text").collect()), key=repr)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
        elif name == "exact_dedup":
            # one of each group, whether ids repeat or are wanting
            got = {}
            for x, t in kept:
                sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
                assert sha not in got
                got[sha] = x
            assert got == {r[4]: r[1] for r in te.brute(before)} and set(kept) <= set(before)
            docs = after
            continue
        elif name == "near_dedup":
            bad = {r[0] for r in tn.brute(before) if not r[3]}
        else:
            found = {(x, t) for (x, t), r in zip(before, td.brute(before, bench)) if r[5]}
            assert {t for x, t in found if x is None or x == 10**6 + 3} and kept == sorted((r for r in before if r not in found), key=repr)
            docs = after
            continue
        assert kept == sorted((r for r in before if r[0] not in bad), key=repr), name
        docs = after


def test_run(spark):
    out = c.run(spark, SF)
    assert out.columns[0] == "doc_id" and out.count() > 0

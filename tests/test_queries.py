"""Each query against its SQL on the driver's tables."""

import oracle
import pytest

from quillspark.functions.packs import LATIN
from quillspark.operators import dimensions as D
from quillspark.operators import parse as P
from quillspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, spark, con):
    oracle.same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_plans(spark):
    native = ("parse_paragraphs", "split_sentences", "connector_tiers", "bigram_avg_prob", "vec_adjacent_similarity", "concept_backtrack")
    for name in (*native, "dims_wide", "paragraph_levels", "document_ai_rate", "fused_levels"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        # counting kernels take batches of columns; nothing goes to Python row by row
        assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan, name
        assert name not in native or "Python" not in plan, name


def test_zones_and_levels_take_one_shuffle(spark):
    plan = registry.QUERIES["sentence_zones_raw"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_statistics_move_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = D.classified(D.dimensions(P.paragraphs(docs, LATIN), LATIN))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = registry.QUERIES["dims_wide"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_reports_count_each_text_once(spark):
    """Rules and vectors are evaluated once each, the concepts read the texts a second time, and no scan meets itself."""
    for name, evaluations, scans in (("fused_json", 2, 2), ("gap_report", 2, 2), ("top5_instructions", 2, 2), ("fused_levels", 2, 2), ("json_report", 1, 1), ("html_documents", 1, 1)):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
        assert plan.count("ArrowEvalPython [") <= evaluations and plan.count("FileScan parquet") <= scans, (name, plan.count("ArrowEvalPython ["), plan.count("FileScan parquet"))

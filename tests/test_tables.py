"""The library in SQL against its DataFrame twins."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillspark import tables
from quillspark.functions.packs import LATIN, ZH
from quillspark.operators import dimensions, parse, sentences

TEXT = "First line is long enough here.\n\n  Second one; with two sentences. And more!\nshort\nReferences and other things\nAfter the references still. More text here."


@pytest.fixture(scope="module")
def docs(spark):
    tables.register(spark)
    rows = [(1, TEXT), (2, None), (3, ""), (4, "x　 y" * 9 + "\n \t \n" + "因此，这很重要。" * 3), (5, TEXT[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.createOrReplaceTempView("own_documents")
    return df


def same(a, b):
    assert a.columns == b.columns or sorted(a.columns) == sorted(b.columns)
    key = lambda df: sorted((tuple(r[c] for c in b.columns) for r in df.collect()), key=repr)
    assert key(a) == key(b) and a.count() > 0


@pytest.mark.parametrize("pack", [LATIN, ZH])
def test_paragraphs_and_sentences(spark, docs, pack):
    par = parse.paragraphs(docs, pack)
    same(spark.sql(f"SELECT d.doc_id, p.* FROM own_documents d, LATERAL split_paragraphs(d.text, '{pack.name}') p"), par)
    same(spark.sql(f"SELECT d.doc_id, p.* FROM own_documents d, LATERAL split_paragraphs(d.text, '{pack.name}', true) p"), parse.sentences(par, pack))


def test_latch_and_dimensions(spark, docs):
    par = parse.paragraphs(docs, LATIN)
    par.createOrReplaceTempView("own_paragraphs")
    same(spark.sql("SELECT * FROM reference_latch(TABLE(own_paragraphs))"), sentences.reference_latch(par, LATIN))
    got = spark.sql("SELECT p.doc_id, p.p_idx, x.dim, round(x.value, 4) AS value FROM own_paragraphs p, LATERAL paragraph_dimensions(p.text, p.prev, 'latin') x")
    same(got, dimensions.unpivoted(dimensions.dimensions(par, LATIN)).select("doc_id", "p_idx", "dim", "value"))


def test_spread_in_any_order_of_rows(spark, docs):
    """Rows come in any order and partitions; the function gets each document's in order."""
    rng = random.Random(3)
    rows = [(d, p, s, rng.choice(["green", "green", "yellow", "orange", "red"]), round(rng.random() / 4, 2), f"{d}-{p}-{s}") for d in range(40) for p in range(rng.randint(1, 4)) for s in range(rng.randint(1, 5))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, p_idx int, s_idx int, zone string, score double, sentence string").repartition(7)
    df.createOrReplaceTempView("own_sentences")
    same(spark.sql("SELECT * FROM spread_zones(TABLE(own_sentences))"), sentences.propagated(df))


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT * FROM split_paragraphs(1)",
        "SELECT * FROM split_paragraphs('a', 'greek')",
        "SELECT * FROM split_paragraphs('a', 'latin', 3)",
        "SELECT * FROM spread_zones(TABLE(SELECT 1 AS doc_id))",
        "SELECT * FROM spread_zones(TABLE(SELECT 1L AS doc_id, 1 AS p_idx, 1 AS s_idx, 2 AS zone, 0.5D AS score))",
        "SELECT * FROM reference_latch(TABLE(SELECT 1 AS doc_id, 2 AS p_idx))",
    ],
)
def test_wrong_arguments_are_told_before_anything_runs(spark, docs, statement):
    with pytest.raises(AnalysisException):
        spark.sql(statement)


def test_views(spark, docs):
    found = tables.views(spark, docs, prefix="v_")
    assert set(found) == {"paragraphs", "sentences", "diagnosis", "fused", "doc_summary"}
    for name, df in found.items():
        same(spark.sql(f"SELECT * FROM v_{name}"), df)
    joined = spark.sql("SELECT s.doc_id, d.ai_rate, count(*) AS n FROM v_sentences s JOIN v_doc_summary d USING (doc_id) GROUP BY ALL")
    assert all(r.n == r2.total_sentences for r, r2 in zip(joined.orderBy("doc_id").collect(), found["doc_summary"].orderBy("doc_id").collect(), strict=True))
    # a view reads only what it needs
    plan = spark.sql("SELECT count(*) FROM v_paragraphs")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_empty_table(spark, docs):
    tables.views(spark, docs.filter(F.lit(False)), prefix="e_")
    assert spark.sql("SELECT * FROM e_doc_summary").count() == 0 == spark.sql("SELECT * FROM spread_zones(TABLE(SELECT * FROM e_sentences))").count()

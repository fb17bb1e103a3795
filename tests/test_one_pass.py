"""Sentences are counted in one pass over their paragraph's text, with what native columns give."""

from pyspark.sql import functions as F

from quillspark.functions.packs import LATIN, ZH
from quillspark.functions.text import hits
from quillspark.operators import parse as P
from quillspark.operators import sentences as T
from quillspark.plans import registry
from quillspark.plans.paragraph_queries import zh_docs

SF = "/root/testdata/sf0.001"
#: Expressions at ends that strip() takes away, templates and formulas in part, starters after others, equal lengths.
ODD = [
    "a but b. However, but then. First this, Second that. Finally so but ",
    "On the one hand it plays a crucial role.\nOn the other hand not only that! but also this; Einerseits",
    "By day we go on. By night we stay in. By noon we rest up. The end is near now.",
    "This paper in short examines all. not only x but y; not only\nxx but yy. ...",
    "...!?", "", "Straße, œuvre: ΑΣ İstanbul   1 22 333. 　", "it should be noted it should be noted crucial crucial.",
]


def test_marks_are_those_of_native_columns(spark):
    odd = spark.createDataFrame([(k, "\n".join(["Put before all others."] * (k % 3)) + "\n" + t) for k, t in enumerate(ODD)], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select(F.col("doc_id") + 100, "text")
    for pack, rows in ((LATIN, odd.union(docs)), (ZH, zh_docs(spark, SF)), (ZH, odd)):
        par = P.paragraphs(rows, pack)
        got = par.select("doc_id", "p_idx", T.counted(F.col("text"), pack).alias("c")).cache()
        keys = ("doc_id", "p_idx")
        native = T.paragraph_signals(par, pack).select(*keys, "template", "parallel", "even", "spread", "sents")
        of = got.select(*keys, "c.template", "c.parallel", "c.even", "c.spread", F.transform("c.sents", lambda s: s.sentence).alias("sents"))
        assert sorted(map(tuple, of.collect())) == sorted(map(tuple, native.collect()))
        sent, s = P.sentences(par, pack), F.col("sentence")
        counts = [hits(s, pack.connectors[k]) for k in ("high", "medium", "low")]
        own = T.sentence_stats(sent, pack).select(*keys, "s_idx", "lexical_diversity", "char_entropy", "word_repetition", "unique_char_ratio", *counts, hits(s, pack.all_slop), T.starter(s, pack).isNotNull(), T.formula(s, pack))
        each = got.select(*keys, F.posexplode("c.sents").alias("s_idx", "s"))
        weight = F.coalesce(T.by_formula([w for _, w, _ in pack.formulas]).cast("double"), F.lit(0.0))
        mine = each.select(*keys, "s_idx", "s.*").select(*keys, "s_idx", "lexical_diversity", "char_entropy", "word_repetition", "unique_char_ratio", "_high", "_medium", "_low", "_slop", "_starts", weight)
        near = lambda r: tuple(round(x, 12) if isinstance(x, float) else x for x in r)
        assert sorted(map(near, mine.collect())) == sorted(map(near, own.collect()))


def test_a_scan_of_sentences_counts_once_and_deals_documents_before(spark):
    for name in ("sentence_zones_raw", "sentence_reasons"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [") == 1 and "rlike" not in plan.lower().partition("window")[0], name
        assert plan.index("ArrowEvalPython [") < plan.index("Exchange hashpartitioning"), name


def test_chinese_documents_stay_spread(spark):
    """The grouping that puts turns together must not leave a small table to one task, as counting takes far longer than the bytes tell."""
    assert zh_docs(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

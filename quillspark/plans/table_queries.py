"""Queries that are SQL themselves, over the library's table functions and views."""

from __future__ import annotations

from ..functions.packs import LATIN, ZH
from ..functions.thresholds import RULE_DIMENSIONS
from .. import tables
from . import sql as S
from .paragraph_queries import PAR, ZPAR, documents, zh_docs
from .sentence_queries import SPREAD, SUMMARY, sent_sql, shared_sql, zones_sql
from .vector_queries import FUSED_SQL

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def _asked(spark, d, statement: str, docs=None, pack=LATIN):
    """A statement over the views of the documents, under names of their own."""
    tables.register(spark)
    docs = documents(spark, d) if docs is None else docs
    docs.createOrReplaceTempView("scan_documents")
    tables.views(spark, docs, pack, prefix="scan_")
    return spark.sql(statement)


@query("sql_split_paragraphs", f"WITH {PAR} SELECT doc_id, p_idx, text, prev FROM par")
def _(spark, d):
    return _asked(spark, d, "SELECT d.doc_id, p.* FROM scan_documents d, LATERAL split_paragraphs(d.text) p")


@query("sql_split_sentences", f"WITH {ZPAR}, {sent_sql(ZH)} SELECT doc_id, p_idx, s_idx, sentence, chars FROM sent")
def _(spark, d):
    return _asked(spark, d, "SELECT d.doc_id, s.* FROM scan_documents d, LATERAL split_paragraphs(d.text, 'zh', true) s", zh_docs(spark, d), ZH)


@query("sql_spread_zones", f"WITH {PAR}, {zones_sql(LATIN)}, {SPREAD} SELECT doc_id, p_idx, s_idx, chars, round(score, 6) AS score, zone FROM zp")
def _(spark, d):
    return _asked(spark, d, "SELECT doc_id, p_idx, s_idx, chars, round(score, 6) AS score, zone FROM spread_zones(TABLE(SELECT doc_id, p_idx, s_idx, chars, score, zone FROM scan_sentences))")


@query("sql_reference_latch", f"WITH {PAR}, {sent_sql(LATIN)}, {shared_sql(LATIN)} SELECT doc_id, p_idx, in_references FROM psig")
def _(spark, d):
    return _asked(spark, d, "SELECT doc_id, p_idx, in_references FROM reference_latch(TABLE(SELECT doc_id, p_idx, text FROM scan_paragraphs), 'latin')")


@query("sql_paragraph_dimensions", f"WITH {PAR}, {S.dims(LATIN)}, {S.unpivoted()} SELECT dim, count(*) AS n, round(avg(value), 3) AS mean FROM lng GROUP BY dim")
def _(spark, d):
    return _asked(spark, d, "SELECT x.dim, count(*) AS n, round(avg(round(x.value, 4)), 3) AS mean FROM scan_paragraphs p, LATERAL paragraph_dimensions(p.text, p.prev) x GROUP BY x.dim")


@query("sql_diagnosis", f"WITH {PAR}, {S.dims(LATIN)}, {S.classified()} SELECT level, count(*) AS n, " + ", ".join(f"round(avg({n[0]}), 4) AS {n[0]}" for n in RULE_DIMENSIONS) + " FROM cls GROUP BY level")
def _(spark, d):
    return _asked(spark, d, "SELECT level, count(*) AS n, " + ", ".join(f"round(avg({n[0]}), 4) AS {n[0]}" for n in RULE_DIMENSIONS) + " FROM scan_diagnosis GROUP BY level")


@query("sql_fused", f"WITH {PAR}, {FUSED_SQL} SELECT fused_level, count(*) AS n FROM fz GROUP BY fused_level")
def _(spark, d):
    # dealt by their ids before they are cut, so that the walk over a document moves no paragraph
    return _asked(spark, d, "SELECT fused_level, count(*) AS n FROM scan_fused GROUP BY fused_level", documents(spark, d, "doc_id"))


@query("sql_doc_summary", f"WITH {PAR}, {zones_sql(LATIN)}, {SPREAD} {SUMMARY}")
def _(spark, d):
    return _asked(spark, d, "SELECT * EXCEPT (ai_rate), round(ai_rate, 6) AS ai_rate FROM scan_doc_summary")

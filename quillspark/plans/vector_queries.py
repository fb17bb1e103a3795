"""Queries on vectors, and on rules and vectors together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.packs import LATIN
from ..functions.thresholds import DESCRIPTIONS, SEMANTIC_DIMENSIONS, SEMANTIC_KEYS, gap_sql, zone_sql
from ..operators import dimensions as D
from ..operators import fusion as U
from ..operators import semantic as V
from ..operators import sentences as T
from ..operators import vector_store
from ..operators.kernels import BUCKETS
from ..operators.vector_store import VectorStore
from ..sources.stored import place
from . import sql as S
from .paragraph_queries import TALK, rounded, talk
from .sentence_queries import SPREAD, zones_sql

#: Vectors that stand for one document.
PARAGRAPHS = 12
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def vectors(spark, d):
    """Runs of vectors stand for the paragraphs of a document."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.floor(F.col("vec_id") / PARAGRAPHS).cast("long").alias("doc_id"), F.col("vec_id").alias("p_idx"), F.col("embedding").alias("vec"))


_E = f"e AS (SELECT vec_id // {PARAGRAPHS} AS doc_id, vec_id AS p_idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_N = "n AS (SELECT *, lead(v) OVER (PARTITION BY doc_id ORDER BY p_idx) AS w FROM e)"


@query("vec_adjacent_similarity", f"WITH {_E}, {_N} SELECT doc_id, p_idx, round(list_dot_product(v, w), 6) AS similarity FROM n")
def _(spark, d):
    return V.adjacent_similarity(vectors(spark, d)).select("doc_id", "p_idx", *rounded("similarity"))


@query("vec_linearity", f"WITH {_E}, {_N}, st AS (SELECT doc_id, list_distance(v, w) AS s FROM n) SELECT doc_id, CASE WHEN count(*) >= 3 THEN round(var_pop(s), 6) ELSE 0.0::DOUBLE END AS argument_linearity FROM st GROUP BY doc_id")
def _(spark, d):
    return V.linearity(vectors(spark, d)).select("doc_id", *rounded("argument_linearity"))


@query("vec_intra_similarity", f"WITH {_E}, g AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id), p AS (SELECT a.doc_id, avg(list_dot_product(a.v, b.v)) AS m FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.p_idx < b.p_idx GROUP BY a.doc_id) SELECT doc_id, round(coalesce(m, -1.0::DOUBLE), 6) AS similarity FROM g LEFT JOIN p USING (doc_id)")
def _(spark, d):
    return V.intra_similarity(vectors(spark, d)).select("doc_id", *rounded("similarity"))


@query("vec_pool_max", "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT e.vec_id, round(max(list_dot_product(e.v, p.v)), 6) AS similarity FROM e, e p WHERE e.label % 2 = 1 AND p.label % 2 = 0 GROUP BY e.vec_id")
def _(spark, d):
    """The vectors of odd labels against the pool of all vectors of even ones, by its cells."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    pool = e.filter("label % 2 = 0").select(F.col("embedding").alias("ref"))
    return V.pool_similarity(e.filter("label % 2 = 1"), pool, ["vec_id"], "embedding", block=64).select("vec_id", *rounded("similarity"))


def _vector_sql(name: str, source: str, text: str) -> str:
    """<name>(doc_id, p_idx, b, x): the entries of lexical vectors that are not 0."""
    return f"""
{name}t AS (SELECT doc_id, p_idx, unnest({S.tokens(text, LATIN)}) AS w FROM {source}),
{name}c AS (SELECT doc_id, p_idx, (len(w) * 5 + unicode(w) + unicode(right(w, 1))) % {BUCKETS} AS b, count(*) AS c FROM {name}t GROUP BY ALL),
{name} AS (SELECT doc_id, p_idx, b, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id, p_idx)) AS x FROM {name}c)"""


_NEXT = "nx AS (SELECT doc_id, p_idx, lead(p_idx) OVER (PARTITION BY doc_id ORDER BY p_idx) AS q FROM par)"
_EDGE = f"""eg AS (SELECT doc_id, p_idx, text, list_filter(list_transform(string_split_regex(text, {S.q(LATIN.edge)}), lambda x: {S.strip("x")}), lambda x: x <> '') AS e FROM par),
ed AS (SELECT doc_id, p_idx, CASE WHEN len(e) > 0 THEN e[1] ELSE left(text, 50) END AS f, CASE WHEN len(e) > 0 THEN e[-1] ELSE right(text, 50) END AS l FROM eg)"""
_BACK = f"""cc AS (SELECT DISTINCT doc_id, p_idx, unnest(regexp_extract_all(lower(text), {S.q(LATIN.concept)})) AS c FROM par),
fs AS (SELECT *, min(p_idx) OVER (PARTITION BY doc_id, c) AS f FROM cc),
sh AS (SELECT par.doc_id, par.p_idx, coalesce(avg(CASE WHEN f < fs.p_idx THEN 1.0::DOUBLE WHEN f IS NOT NULL THEN 0.0::DOUBLE END), 0.0::DOUBLE) AS s FROM par LEFT JOIN fs USING (doc_id, p_idx) GROUP BY ALL),
kk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p_idx) AS k FROM sh),
bt AS (SELECT doc_id, CASE WHEN count(*) >= 3 THEN count(*) FILTER (k > 2 AND s > 0.5)::DOUBLE / (count(*) - 2) ELSE 0.0::DOUBLE END AS rate FROM kk GROUP BY doc_id)"""
_SEM = f"""{_NEXT}, {_EDGE}, {_BACK}, {_vector_sql("pv", "par", "text")}, {_vector_sql("fv", "ed", "f")}, {_vector_sql("lv", "ed", "l")},
aj AS (SELECT nx.doc_id, nx.p_idx, CASE WHEN nx.q IS NOT NULL THEN coalesce((SELECT sum(a.x * b.x) FROM pv a JOIN pv b ON a.b = b.b WHERE a.doc_id = nx.doc_id AND a.p_idx = nx.p_idx AND b.doc_id = nx.doc_id AND b.p_idx = nx.q), 0.0::DOUBLE) END AS s,
       CASE WHEN nx.q IS NOT NULL THEN coalesce((SELECT sum(a.x * b.x) FROM lv a JOIN fv b ON a.b = b.b WHERE a.doc_id = nx.doc_id AND a.p_idx = nx.p_idx AND b.doc_id = nx.doc_id AND b.p_idx = nx.q), 0.0::DOUBLE) END AS t FROM nx),
nm AS (SELECT doc_id, p_idx, sum(x * x) AS m FROM pv GROUP BY ALL),
sp AS (SELECT aj.doc_id, CASE WHEN q IS NOT NULL THEN sqrt(greatest(coalesce(a.m, 0) + coalesce(b.m, 0) - 2 * s, 0)) END AS d FROM aj JOIN nx USING (doc_id, p_idx) LEFT JOIN nm a ON a.doc_id = aj.doc_id AND a.p_idx = aj.p_idx LEFT JOIN nm b ON b.doc_id = nx.doc_id AND b.p_idx = nx.q),
ln AS (SELECT doc_id, CASE WHEN count(*) >= 3 THEN var_pop(d) ELSE 0.0::DOUBLE END AS lin FROM sp GROUP BY doc_id),
mn AS (SELECT doc_id FROM par GROUP BY doc_id HAVING count(*) >= 2),
sv AS (SELECT aj.doc_id, aj.p_idx, round(s, 4) AS v0, round(lin, 6) AS v1, round(rate, 4) AS v2, round(t, 4) AS v3 FROM aj JOIN ln USING (doc_id) JOIN bt USING (doc_id) JOIN mn USING (doc_id)),
sem AS ({" UNION ALL ".join(f"SELECT doc_id, p_idx, '{d[0]}' AS dim, {k} AS dim_ord, coalesce(v{k}, 0.0::DOUBLE) AS value, CASE WHEN v{k} IS NULL THEN 'unknown' ELSE {zone_sql(f'v{k}', d)} END AS zone, CASE WHEN v{k} IS NULL THEN 0.0::DOUBLE ELSE {gap_sql(f'v{k}', d)} END AS gap FROM sv" for k, d in enumerate(SEMANTIC_DIMENSIONS))})"""


#: sem from par.
SEMANTIC = _SEM


@query("concept_backtrack", f"WITH {TALK}, {_BACK} SELECT doc_id, round(rate, 6) AS semantic_backtrack_rate FROM bt")
def _(spark, d):
    return V.backtrack(talk(spark, d), LATIN).select("doc_id", *rounded("semantic_backtrack_rate"))


@query("semantic_documents", f"""WITH {TALK}, {_SEM.partition("mn AS (")[0]} n AS (SELECT doc_id, count(*) AS n FROM par GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN n >= 3 THEN lin ELSE 0.0::DOUBLE END, 6) AS argument_linearity, round(CASE WHEN n >= 3 THEN rate ELSE 0.0::DOUBLE END, 4) AS semantic_backtrack_rate, CASE WHEN n < 2 THEN {S.q(V.TOO_SHORT)} END AS error FROM n JOIN ln USING (doc_id) JOIN bt USING (doc_id)""")
def _(spark, d):
    return V.semantic_documents(talk(spark, d), LATIN).select("doc_id", *rounded("argument_linearity"), F.round("semantic_backtrack_rate", 4).alias("semantic_backtrack_rate"), "error")


@query("semantic_zones", f"WITH {TALK}, {_SEM} SELECT doc_id, p_idx, dim, round(value, 4) AS value, zone, round(gap, 4) AS gap FROM sem")
def _(spark, d):
    return V.semantic(talk(spark, d), LATIN).select("doc_id", "p_idx", "dim", F.round("value", 4).alias("value"), "zone", F.round("gap", 4).alias("gap"))


_RULES = f"WITH {TALK}, {S.dims(LATIN)}, {S.classified()}, {S.unpivoted()}, {_SEM}"


#: fz: levels of both layers, from par.
FUSED_LEVEL_SQL = """fz AS (SELECT doc_id, p_idx, CASE WHEN s IS NULL THEN level WHEN ai_count + s >= 10 THEN 'deep_red' WHEN ai_count + s >= 6 THEN 'red' WHEN ai_count + s >= 3 THEN 'yellow' WHEN level IN ('red', 'deep_red') THEN 'red' WHEN level = 'yellow' THEN 'yellow' ELSE 'green' END AS fused_level
  FROM cls LEFT JOIN sa USING (doc_id, p_idx))"""
FUSED_SQL = f"{S.dims(LATIN)}, {S.classified()}, {_SEM}, sa AS (SELECT doc_id, p_idx, count(*) FILTER (zone = 'ai') AS s FROM sem GROUP BY ALL), {FUSED_LEVEL_SQL}"


@query("fused_levels", f"""{_RULES}, sa AS (SELECT doc_id, p_idx, count(*) FILTER (zone = 'ai') AS s FROM sem GROUP BY ALL)
SELECT doc_id, p_idx, level AS rule_level, ai_count AS rule_ai_count, CAST(coalesce(s, 0) AS INTEGER) AS semantic_ai_count, CASE WHEN s IS NULL THEN 12 ELSE 16 END AS total_dimensions, CAST(ai_count + coalesce(s, 0) AS INTEGER) AS combined_ai_count,
  round(CASE WHEN s IS NULL THEN comprehensive_score ELSE (ai_count + s)::DOUBLE / 16 END, 6) AS combined_score,
  CASE WHEN s IS NULL THEN level WHEN ai_count + s >= 10 THEN 'deep_red' WHEN ai_count + s >= 6 THEN 'red' WHEN ai_count + s >= 3 THEN 'yellow' WHEN level IN ('red', 'deep_red') THEN 'red' WHEN level = 'yellow' THEN 'yellow' ELSE 'green' END AS fused_level
FROM cls LEFT JOIN sa USING (doc_id, p_idx)""")
def _(spark, d):
    rows = U.together(talk(spark, d), LATIN)
    return rows.select("doc_id", "p_idx", "rule_level", "rule_ai_count", "semantic_ai_count", "total_dimensions", "combined_ai_count", *rounded("combined_score"), "fused_level")


_KEYS = "sk AS (SELECT * FROM (VALUES " + ", ".join(f"({S.q(d)}, {S.q(n)}, {100 + k}, {S.q(DESCRIPTIONS[d])})" for k, (d, n) in enumerate(SEMANTIC_KEYS.items())) + ") t(dim, name, ord, description))"
GAPS = f"""{_RULES}, {_KEYS}, gp AS (SELECT doc_id, p_idx, 'rule' AS layer, dim, dim_ord, description, value, gap FROM lng WHERE zone = 'ai' UNION ALL SELECT doc_id, p_idx, 'embedding', sk.name, sk.ord, sk.description, value, gap FROM sem JOIN sk USING (dim) WHERE zone = 'ai'),
gr AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, p_idx ORDER BY round(gap, 6) DESC, dim_ord) AS INTEGER) AS rank FROM gp)"""


def _report(spark, d):
    return U.gap_report(U.together(talk(spark, d), LATIN))


@query("gap_report", f"{GAPS} SELECT doc_id, p_idx, layer, dim, description, round(value, 6) AS value, round(gap, 4) AS gap, rank FROM gr")
def _(spark, d):
    return _report(spark, d).select("doc_id", "p_idx", "layer", "dim", "description", F.round("value", 6).alias("value"), F.round("gap", 4).alias("gap"), "rank")


#: As reports write numbers: without zeros at the end but one, and with an exponent below 0.0001.
_NUMBER = """CASE WHEN value > 0 AND round(value * 1e6) < 10 THEN CAST(CAST(round(value * 1e6) AS BIGINT) AS VARCHAR) || 'e-06'
  WHEN value > 0 AND round(value * 1e6) < 100 THEN regexp_replace(printf('%.1f', round(value * 1e6) / 10), '\\.0$', '') || 'e-05' ELSE regexp_replace(regexp_replace(printf('%.6f', value), '0+$', ''), '\\.$', '.0') END"""
_TOLD = "told AS (SELECT * FROM (VALUES " + ", ".join(f"({S.q(k)}, {S.q(v)})" for k, v in U.INSTRUCTIONS.items()) + ") t(dim, told))"


@query("top5_instructions", f"{GAPS}, {_TOLD} SELECT doc_id, p_idx, rank, coalesce(told, '减少 ' || description || ' 的AI特征 (当前: ' || {_NUMBER} || ', 差距: ' || printf('%.2f', round(gap, 2)) || ')') AS instruction FROM gr LEFT JOIN told USING (dim) WHERE rank <= 5")
def _(spark, d):
    return U.instructions(spark, _report(spark, d))


@query("high_risk_count", f"""{_RULES}, sa AS (SELECT doc_id, p_idx, count(*) FILTER (zone = 'ai') AS s FROM sem GROUP BY ALL)
SELECT count(*) AS paragraphs, count(*) FILTER (CASE WHEN s IS NULL THEN level IN ('red', 'deep_red') ELSE ai_count + s >= 6 OR (ai_count + s < 3 AND level IN ('red', 'deep_red')) END) AS high_risk FROM cls LEFT JOIN sa USING (doc_id, p_idx)""")
def _(spark, d):
    rows = U.together(talk(spark, d), LATIN)
    return rows.agg(F.count(F.lit(1)).alias("paragraphs"), F.count_if(F.col("fused_level").isin("red", "deep_red")).alias("high_risk"))


@query("dims_by_vectors", f"""WITH {TALK}, {S.dims(LATIN)}, {_vector_sql("pv", "par", "text")}, sv AS (SELECT a.doc_id, a.p_idx, sum(a.x * b.x) AS s FROM pv a JOIN pv b ON a.doc_id = b.doc_id AND b.p_idx = a.p_idx - 1 AND a.b = b.b GROUP BY ALL),
dv AS (SELECT par.doc_id, par.p_idx, CASE WHEN prev = '' OR text = '' THEN 0.0::DOUBLE ELSE round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, coalesce(s, 0))), 4) END AS v FROM par LEFT JOIN sv USING (doc_id, p_idx)),
dx AS (SELECT dims.* REPLACE (v AS paragraph_similarity) FROM dims JOIN dv USING (doc_id, p_idx)), {S.classified().replace('FROM dims)', 'FROM dx)')}
SELECT doc_id, p_idx, paragraph_similarity, ai_count, level FROM cls""")
def _(spark, d):
    """The twelve statistics with vectors, kept in a store, for the likeness of neighbouring paragraphs."""
    rows, path = talk(spark, d), place(spark, "vectors")
    store = VectorStore(spark, path, "lexical-1", V.lexical_encoder(LATIN))
    return D.classified(vector_store.dimensions(rows, LATIN, store)).select("doc_id", "p_idx", "paragraph_similarity", "ai_count", "level")


SENTENCE_VECTORS = f"""{_vector_sql("pv", "par", "text")}, {_vector_sql("sv0", "(SELECT doc_id, p_idx * 1000000 + s_idx AS p_idx, sentence AS text FROM sent WHERE chars >= 5)", "text")},
sv AS (SELECT doc_id, p_idx // 1000000 AS p_idx, p_idx % 1000000 AS s_idx, b, x FROM sv0),
sc AS (SELECT doc_id, p_idx, count(*) AS n FROM sent WHERE chars >= 5 GROUP BY ALL),
su AS (SELECT doc_id, p_idx, sum(s * s) - sum(q) AS m FROM (SELECT doc_id, p_idx, b, sum(x) AS s, sum(x * x) AS q FROM sv GROUP BY ALL) GROUP BY ALL),
un AS (SELECT sc.doc_id, sc.p_idx, CASE WHEN n >= 2 THEN coalesce(m, 0) / (n * (n - 1)) ELSE -1.0::DOUBLE END AS u FROM sc LEFT JOIN su USING (doc_id, p_idx)),
bp AS (SELECT item_id AS doc_id, 0 AS p_idx, text FROM benchmark), {_vector_sql("bv", "bp", "text")},
hm AS (SELECT doc_id, p_idx, max(c) AS h FROM (SELECT pv.doc_id, pv.p_idx, bv.doc_id AS r, sum(pv.x * bv.x) AS c FROM pv JOIN bv USING (b) GROUP BY ALL) GROUP BY ALL),
sv2 AS (SELECT par.doc_id, par.p_idx, CASE WHEN u > 0.82 THEN 0.14 WHEN u > 0.72 THEN 0.08 ELSE 0 END::DOUBLE AS un,
  CASE WHEN len(trim(text)) < 20 OR coalesce(h, 0) > 0.65 THEN 0 WHEN h > 0.5 THEN 0.04 WHEN h > 0.35 THEN 0.1 ELSE 0.16 END::DOUBLE AS hu FROM par LEFT JOIN un USING (doc_id, p_idx) LEFT JOIN hm USING (doc_id, p_idx)),"""
_VECTOR_ZONES = zones_sql(LATIN, more="coalesce(sv2.un, 0) + sv2.hu", joins="JOIN sv2 ON sv2.doc_id = st.doc_id AND sv2.p_idx = st.p_idx", before=SENTENCE_VECTORS)


def told_by_vectors(spark, d, rows):
    """Signals of vectors, with the benchmark's texts as the known ones. An encoder that fails ends the query."""
    make = V.lexical_encoder(LATIN)
    known = V.encoded(spark.read.parquet(f"{d}/benchmark.parquet").select("text"), "text", make, "ref", strict=True).select("ref")
    return V.signals(rows, LATIN, known, make, strict=True)


@query("sentence_zones_vectors", f"WITH {TALK}, {_VECTOR_ZONES}, {SPREAD} SELECT doc_id, p_idx, s_idx, round(score, 4) AS score, zone FROM zp")
def _(spark, d):
    """Conversations with the signals of vectors: how alike the sentences of a paragraph are, and how near it is to known texts (the benchmark's)."""
    rows = talk(spark, d)
    zones = T.propagated(T.zones_raw(rows, LATIN, told_by_vectors(spark, d, rows)))
    return zones.select("doc_id", "p_idx", "s_idx", F.round("score", 4).alias("score"), "zone")

"""Queries on sentences: signals, zones, documents; and the text models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.packs import LATIN, ZH
from ..operators import models as M
from ..operators import parse as P
from ..operators import sentences as T
from ..sources.readers import spread
from . import sql as S
from .paragraph_queries import PAR, TALK, ZPAR, par, par_by_document, rounded, talk, zh_docs

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def sent_sql(pack) -> str:
    return f"""
sl AS (SELECT doc_id, p_idx, text, {S.sentence_list("text", pack)} AS ss FROM par),
sent AS (SELECT doc_id, p_idx, CAST(i - 1 AS INTEGER) AS s_idx, len(ss) AS n_sents, ss[i] AS sentence, CAST(len(ss[i]) AS INTEGER) AS chars FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM sl))"""


def stats_sql(pack) -> str:
    bare = "replace(replace(sentence, ' ', ''), chr(10), '')"
    tk = S.tokens(bare if pack.name == "zh" else "sentence", pack)
    return f"""
st0 AS (SELECT *, {bare} AS bare, {tk} AS tk FROM sent),
st AS (SELECT *, CASE WHEN len(bare) >= 5 AND len(tk) > 0 THEN len(list_distinct(tk))::DOUBLE / len(tk) ELSE 1.0::DOUBLE END AS lexical_diversity,
  CASE WHEN len(bare) >= 5 THEN list_aggregate(string_split(bare, ''), 'entropy') ELSE 0.0::DOUBLE END AS char_entropy,
  CASE WHEN len(bare) >= 5 THEN coalesce(len(list_filter(map_values(list_aggregate(tk, 'histogram')), lambda c: c >= 3)), 0) ELSE 0 END AS word_repetition,
  CASE WHEN len(bare) >= 5 THEN len(list_distinct(string_split(bare, '')))::DOUBLE / len(bare) ELSE 1.0::DOUBLE END AS unique_char_ratio FROM st0)"""


def template_sql(pack) -> str:
    one = lambda parts, w: f"(CASE WHEN {' + '.join(f'CAST(regexp_matches(text, {S.q(p)}) AS INTEGER)' for p in parts)} >= {len(parts) * 0.6!r} THEN {round(w * 100)} ELSE 0 END)"
    return f"(({' + '.join(one(*t) for t in pack.templates)}) / 100.0::DOUBLE)"


def starter_sql(x: str, pack) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({x}, {S.q(p)}) THEN regexp_extract({x}, {S.q(p)}, 1) END" for p in pack.starters) + ")"


def formula_sql(x: str, pack) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {S.q(p)}) THEN {w!r}::DOUBLE" for p, w, _ in pack.formulas) + " ELSE 0.0::DOUBLE END"


def shared_sql(pack) -> str:
    """psig: what the sentences of a paragraph share."""
    return f"""
kc AS (SELECT doc_id, p_idx, max(n) AS most FROM (SELECT doc_id, p_idx, k, count(*) AS n FROM (SELECT doc_id, p_idx, {starter_sql("sentence", pack)} AS k FROM sent) WHERE k IS NOT NULL GROUP BY doc_id, p_idx, k) GROUP BY doc_id, p_idx),
lc AS (SELECT doc_id, p_idx, count(*) AS n, stddev_pop(chars) AS sd FROM sent WHERE chars >= 10 GROUP BY ALL),
rf AS (SELECT doc_id, p_idx, max(CAST(regexp_matches({S.strip("text")}, {S.q(pack.references)}) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p_idx) = 1 AS in_references FROM par),
psig AS (SELECT par.doc_id, par.p_idx, {template_sql(pack)} AS template,
  CASE WHEN len({S.sentence_list("text", pack)}) >= 3 AND coalesce(most, 0) >= 3 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS parallel,
  CASE WHEN coalesce(lc.n, 0) < 3 THEN 0.0::DOUBLE WHEN sd < 5 THEN 0.1::DOUBLE WHEN sd < 8 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END AS even, sd, in_references
  FROM par LEFT JOIN kc USING (doc_id, p_idx) LEFT JOIN lc USING (doc_id, p_idx) JOIN rf USING (doc_id, p_idx))"""


def connector_sql(x: str, pack) -> str:
    h, m, lo = (S.hits(x, pack.connectors[k]) for k in ("high", "medium", "low"))
    return f"CASE WHEN {h} >= 2 THEN 0.3 WHEN {h} = 1 THEN 0.18 WHEN {m} >= 2 THEN 0.22 WHEN {m} = 1 THEN 0.1 WHEN {lo} >= 2 THEN 0.08 WHEN {lo} = 1 THEN 0.04 ELSE 0 END::DOUBLE"


def self_sql(pack) -> str:
    """sp: how well a paragraph foretells itself; ow: what that counts."""
    return f"""
s_t AS (SELECT doc_id, p_idx, {S.tokens("text", pack)} AS t FROM par),
s_h AS (SELECT doc_id, p_idx, len(t) AS n, t[1:len(t) // 2] AS a, t[len(t) // 2 + 1:] AS b FROM s_t),
s_f AS (SELECT doc_id, p_idx, w, count(*) AS f FROM (SELECT doc_id, p_idx, unnest(a) AS w FROM s_h) GROUP BY ALL),
s_v AS (SELECT doc_id, p_idx, count(*) AS v FROM s_f GROUP BY ALL),
s_r AS (SELECT h.doc_id, h.p_idx, avg(CASE WHEN f.f IS NULL THEN log2(len(a) + v.v + 1) ELSE -log2(greatest(f.f::DOUBLE / len(a), 1e-8)) END) AS cost, avg(CASE WHEN f.f IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fresh
      FROM (SELECT *, unnest(b) AS w FROM s_h WHERE n >= 20) h JOIN s_v v USING (doc_id, p_idx) LEFT JOIN s_f f ON f.doc_id = h.doc_id AND f.p_idx = h.p_idx AND f.w = h.w GROUP BY ALL),
sp AS (SELECT h.doc_id, h.p_idx, coalesce(power(2, cost), -1.0::DOUBLE) AS self_ppl, coalesce(fresh, -1.0::DOUBLE) AS new_word_ratio FROM s_h h LEFT JOIN s_r r USING (doc_id, p_idx)),
ow AS (SELECT doc_id, p_idx, self_ppl, CASE WHEN self_ppl < 0 THEN -1.0 ELSE CASE WHEN round(self_ppl, 2) < 6 THEN 0.1 WHEN round(self_ppl, 2) < 12 THEN 0.05 ELSE 0 END + CASE WHEN round(new_word_ratio, 3) < 0.25 THEN 0.05 WHEN round(new_word_ratio, 3) < 0.4 THEN 0.02 ELSE 0 END END::DOUBLE AS o FROM sp)"""


def zones_sql(pack, more: str = "0.0::DOUBLE", joins: str = "", before: str = "", bigram: str = "0.0::DOUBLE") -> str:
    """zr: raw zones. more: a further sum of signals, from what `before` defines and `joins` brings in; bigram: that of word pairs."""
    return f"""{sent_sql(pack)}, {before} {S.scanned(pack, False)}, {stats_sql(pack)}, {shared_sql(pack)}, {self_sql(pack)},
zs AS (SELECT st.doc_id, st.p_idx, st.s_idx, sentence, chars, CASE WHEN in_references THEN 0.0::DOUBLE ELSE
  CASE WHEN chars >= 15 THEN (CASE WHEN lexical_diversity < 0.55 THEN 0.1 WHEN lexical_diversity < 0.68 THEN 0.05 ELSE 0 END + CASE WHEN char_entropy < 3 THEN 0.07 WHEN char_entropy < 3.8 THEN 0.03 ELSE 0 END
    + CASE WHEN word_repetition >= 3 THEN 0.1 WHEN word_repetition >= 2 THEN 0.05 ELSE 0 END + CASE WHEN unique_char_ratio < 0.5 THEN 0.07 WHEN unique_char_ratio < 0.62 THEN 0.03 ELSE 0 END)::DOUBLE ELSE 0.0::DOUBLE END
  + {connector_sql("sentence", pack)} + CASE WHEN {S.hits("sentence", pack.all_slop)} >= 1 THEN 0.28 ELSE 0 END::DOUBLE + template * 0.4::DOUBLE
  + CASE WHEN parallel > 0 AND {starter_sql("sentence", pack)} IS NOT NULL THEN parallel ELSE 0.0::DOUBLE END + {formula_sql("sentence", pack)}
  + CASE WHEN chars >= 10 THEN even ELSE 0.0::DOUBLE END + CASE WHEN chars BETWEEN 15 AND 25 THEN 0.03 ELSE 0 END::DOUBLE + CASE WHEN st.s_idx = 0 THEN 0.04 ELSE 0 END::DOUBLE
  + CASE WHEN st.s_idx = n_sents - 1 AND n_sents > 1 THEN 0.03 ELSE 0 END::DOUBLE + CASE WHEN level IN ('red', 'deep_red') THEN 0.18 WHEN level = 'yellow' THEN 0.1 ELSE 0 END::DOUBLE + 0.03::DOUBLE + CASE WHEN {bigram} + ow.o > 0 THEN {bigram} + ow.o ELSE 0.0::DOUBLE END + {more} END AS raw
  FROM st JOIN psig USING (doc_id, p_idx) JOIN cls USING (doc_id, p_idx) JOIN ow USING (doc_id, p_idx) {joins} WHERE chars >= 5),
zr AS (SELECT doc_id, p_idx, s_idx, sentence, chars, least(raw, 1.0::DOUBLE) AS score,
  CASE WHEN round(raw, 6) >= 0.26 THEN 'red' WHEN round(raw, 6) >= 0.2 THEN 'orange' WHEN round(raw, 6) >= 0.1 THEN 'yellow' ELSE 'green' END AS zone FROM zs)"""


#: zp: the spread as a recurrence over the list of a document's zones, one step a sentence.
SPREAD = """
seq AS (SELECT doc_id, list(zone ORDER BY p_idx, s_idx) AS z, list(score ORDER BY p_idx, s_idx) AS sc, list({'p': p_idx, 's': s_idx, 'c': chars} ORDER BY p_idx, s_idx) AS w FROM zr GROUP BY doc_id),
walk AS (SELECT doc_id, w, sc, z, list_reduce(range(1, len(z) + 1), lambda acc, i: list_append(acc, CASE
    WHEN i = 1 OR i = len(z) THEN z[i]
    WHEN z[i] = 'green' AND (acc[i - 1] = 'red' OR z[i + 1] = 'red') THEN 'orange'
    WHEN z[i] = 'green' AND (acc[i - 1] IN ('orange', 'yellow') OR z[i + 1] IN ('orange', 'yellow')) THEN 'yellow'
    WHEN z[i] = 'yellow' AND (acc[i - 1] = 'red' OR z[i + 1] = 'red') THEN 'orange'
    ELSE z[i] END), CAST([] AS VARCHAR[])) AS y FROM seq),
zp AS (SELECT doc_id, w[i].p AS p_idx, w[i].s AS s_idx, w[i].c AS chars, y[i] AS zone, greatest(sc[i], CASE
    WHEN i = 1 OR i = len(z) THEN 0.0::DOUBLE
    WHEN z[i] = 'green' AND (y[i - 1] = 'red' OR z[i + 1] = 'red') THEN 0.22::DOUBLE
    WHEN z[i] = 'green' AND (y[i - 1] = 'orange' OR z[i + 1] = 'orange') THEN 0.1::DOUBLE
    WHEN z[i] = 'green' AND (y[i - 1] = 'yellow' OR z[i + 1] = 'yellow') THEN 0.08::DOUBLE
    WHEN z[i] = 'yellow' AND (y[i - 1] = 'red' OR z[i + 1] = 'red') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) AS score
  FROM (SELECT *, unnest(range(1, len(z) + 1)) AS i FROM walk))"""
SUMMARY = """SELECT doc_id, CAST(sum(chars) AS BIGINT) AS total_chars, CAST(sum(CASE WHEN zone IN ('red', 'orange') THEN chars ELSE 0 END) AS DOUBLE) AS ai_chars,
  round(sum(CASE WHEN zone IN ('red', 'orange') THEN chars ELSE 0 END)::DOUBLE / sum(chars), 6) AS ai_rate, count(*) AS total_sentences, count(*) FILTER (zone = 'red') AS ai_sentences,
  count(*) FILTER (zone <> 'green') AS suspect_sentences, count(*) FILTER (zone = 'red') AS red_count, count(*) FILTER (zone = 'orange') AS orange_count, count(*) FILTER (zone = 'yellow') AS yellow_count
FROM zp GROUP BY doc_id"""


def zh_par(spark, d):
    return P.paragraphs(zh_docs(spark, d), ZH)


def _both(name: str, latin: bool, tail, make, by_document: bool = False) -> None:
    for key, pack, source, rows in ((name, LATIN, PAR, par_by_document if by_document else par), (f"zh_{name}", ZH, ZPAR, zh_par)):
        if latin or pack is ZH:
            query(key if latin else name, f"WITH {source}, {tail(pack)}")(lambda spark, d, pack=pack, rows=rows: make(rows(spark, d), pack))


_both(
    "sentence_stats", True,
    lambda p: f"{sent_sql(p)}, {stats_sql(p)} SELECT doc_id, p_idx, s_idx, round(lexical_diversity, 6) AS lexical_diversity, round(char_entropy, 6) AS char_entropy, CAST(word_repetition AS INTEGER) AS word_repetition, round(unique_char_ratio, 6) AS unique_char_ratio FROM st",
    lambda rows, p: T.sentence_stats(P.sentences(rows, p), p).select("doc_id", "p_idx", "s_idx", *rounded("lexical_diversity", "char_entropy"), "word_repetition", *rounded("unique_char_ratio")),
)
_both("template_score", False, lambda p: f"t AS (SELECT doc_id, p_idx, {template_sql(p)} AS template FROM par) SELECT doc_id, p_idx, round(template, 6) AS template FROM t", lambda rows, p: T.paragraph_signals(rows, p).select("doc_id", "p_idx", *rounded("template")))
_both("parallel_starters", False, lambda p: f"{sent_sql(p)}, {shared_sql(p)} SELECT doc_id, p_idx, parallel FROM psig", lambda rows, p: T.paragraph_signals(rows, p).select("doc_id", "p_idx", "parallel"))
_both("academic_formula", False, lambda p: f"{sent_sql(p)} SELECT doc_id, p_idx, s_idx, {formula_sql('sentence', p)} AS weight FROM sent", lambda rows, p: P.sentences(rows, p).select("doc_id", "p_idx", "s_idx", T.formula(F.col("sentence"), p).alias("weight")))
_both("connector_tiers", True, lambda p: f"{sent_sql(p)} SELECT doc_id, p_idx, s_idx, {connector_sql('sentence', p)} AS signal, CAST({S.hits('sentence', p.all_slop)} AS INTEGER) AS slop_hits FROM sent", lambda rows, p: P.sentences(rows, p).select("doc_id", "p_idx", "s_idx", T.connector_signal(F.col("sentence"), p).cast("double").alias("signal"), T.hits(F.col("sentence"), p.all_slop).alias("slop_hits")))
_both("length_uniformity", True, lambda p: f"{sent_sql(p)}, {shared_sql(p)} SELECT doc_id, p_idx, even FROM psig", lambda rows, p: T.paragraph_signals(rows, p).select("doc_id", "p_idx", "even"))
_both("references_latch", True, lambda p: f"{sent_sql(p)}, {shared_sql(p)} SELECT doc_id, p_idx, in_references FROM psig", lambda rows, p: T.reference_latch(rows, p).select("doc_id", "p_idx", "in_references"))
_both("sentence_zones_raw", True, lambda p: f"{zones_sql(p)} SELECT doc_id, p_idx, s_idx, chars, round(score, 6) AS score, zone FROM zr", lambda rows, p: T.zones_raw(rows, p).select("doc_id", "p_idx", "s_idx", "chars", *rounded("score"), "zone"), True)
_both("sentence_zones_propagated", True, lambda p: f"{zones_sql(p)}, {SPREAD} SELECT doc_id, p_idx, s_idx, chars, round(score, 6) AS score, zone FROM zp", lambda rows, p: T.propagated(T.zones_raw(rows, p)).select("doc_id", "p_idx", "s_idx", "chars", *rounded("score"), "zone"), True)
_both("document_ai_rate", True, lambda p: f"{zones_sql(p)}, {SPREAD} {SUMMARY}", lambda rows, p: T.document_summary(T.propagated(T.zones_raw(rows, p))).withColumn("ai_rate", F.round("ai_rate", 6)), True)
_both("document_verdict", True, lambda p: f"{zones_sql(p)}, {SPREAD}, sm AS ({SUMMARY}) SELECT doc_id, CASE WHEN ai_rate > 0.4 THEN 'high' WHEN ai_rate > 0.15 THEN 'partial' ELSE 'safe' END AS verdict FROM sm", lambda rows, p: T.document_summary(T.propagated(T.zones_raw(rows, p))).select("doc_id", T.verdict(F.round("ai_rate", 6)).alias("verdict")), True)
_both(
    "zone_shares", True,
    lambda p: f"{zones_sql(p)}, {SPREAD} SELECT zone, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share, CASE WHEN zone <> 'green' THEN round(count(*)::DOUBLE / sum(count(*)) FILTER (zone <> 'green') OVER (), 6) END AS share_of_suspect FROM zp GROUP BY zone",
    lambda rows, p: T.zone_shares(T.propagated(T.zones_raw(rows, p))).select("zone", "n", *rounded("share", "share_of_suspect")),
    True,
)


def reasons_sql(pack) -> str:
    """The reasons of a sentence, but those of models; from st joined with psig."""
    h, m = (S.hits("sentence", pack.connectors[k]) for k in ("high", "medium"))
    names = "CASE " + " ".join(f"WHEN regexp_matches(sentence, {S.q(p)}) THEN {S.q(name)}" for p, _, name in pack.formulas) + " END"
    said = [
        "CASE WHEN chars >= 15 AND lexical_diversity < 0.55 THEN '词汇重复(' || printf('%.0f', 100 * lexical_diversity) || '%)' END",
        "CASE WHEN chars >= 15 AND char_entropy < 3 THEN '字熵低(' || printf('%.1f', char_entropy) || ')' END",
        "CASE WHEN chars >= 15 AND word_repetition >= 3 THEN '词重复x' || word_repetition END",
        "CASE WHEN chars >= 15 AND unique_char_ratio < 0.5 THEN '字面单调(' || printf('%.0f', 100 * unique_char_ratio) || '%)' END",
        f"CASE WHEN {h} >= 1 THEN '高连接词x' || {h} WHEN {m} >= 2 THEN '中连接词x' || {m} END",
        f"CASE WHEN {S.hits('sentence', pack.all_slop)} >= 1 THEN 'Slop模式' END",
        f"CASE WHEN parallel > 0 AND {starter_sql('sentence', pack)} IS NOT NULL THEN '排比句式' END",
        names,
        "CASE WHEN s_idx = 0 AND even > 0 AND chars >= 10 THEN '句长均匀(std=' || printf('%.1f', sd) || ')' END",
        "CASE WHEN s_idx = 0 AND o > 0 THEN '低困惑度:自洽(self_ppl=' || printf('%.1f', self_ppl) || ')' END",
        "CASE WHEN s_idx = 0 THEN '段首句' END",
    ]
    return f"CASE WHEN in_references THEN ['参考文献(保护)'] ELSE list_filter([{', '.join(said)}], lambda x: x IS NOT NULL) END"


_both(
    "sentence_reasons", True,
    lambda p: f"{sent_sql(p)}, {stats_sql(p)}, {shared_sql(p)}, {self_sql(p)}, r AS (SELECT doc_id, p_idx, s_idx, in_references, {reasons_sql(p)} AS reasons FROM st JOIN psig USING (doc_id, p_idx) JOIN ow USING (doc_id, p_idx) WHERE chars >= 5) SELECT doc_id, p_idx, s_idx, array_to_string(reasons, '|') AS reasons, CASE WHEN in_references THEN 0 ELSE CAST(len(reasons) AS INTEGER) END AS ai_dim_count FROM r",
    lambda rows, p: T.zones_raw(rows, p).select("doc_id", "p_idx", "s_idx", F.array_join("reasons", "|").alias("reasons"), "ai_dim_count"),
    True,
)


@query("self_perplexity", f"WITH {PAR}, {self_sql(LATIN)} SELECT doc_id, p_idx, round(self_ppl, 4) AS self_ppl, round(new_word_ratio, 6) AS new_word_ratio FROM sp")
def _(spark, d):
    return T.self_perplexity(par(spark, d), LATIN).select("doc_id", "p_idx", F.round("self_ppl", 4).alias("self_ppl"), *rounded("new_word_ratio"))


_LM = f"""bt AS (SELECT item_id, {S.tokens("text", LATIN)} AS t FROM benchmark),
bg AS (SELECT t[i] AS w1, t[i + 1] AS w2 FROM (SELECT t, unnest(range(1, len(t))) AS i FROM bt)),
lm AS (SELECT w1, w2, (count(*) + 1)::DOUBLE / (sum(count(*)) OVER (PARTITION BY w1) + count(*) OVER (PARTITION BY w1)) AS p FROM bg GROUP BY w1, w2)"""


@query("bigram_lm", f"WITH {_LM} SELECT w1, w2, round(p, 6) AS p FROM lm")
def _(spark, d):
    return M.bigram_model(spark.read.parquet(f"{d}/benchmark.parquet"), LATIN).select("w1", "w2", *rounded("p"))


@query("bigram_avg_prob", f"""WITH {_LM}, {PAR}, pt AS (SELECT doc_id, p_idx, {S.tokens("text", LATIN)} AS t FROM par),
pb AS (SELECT doc_id, p_idx, t[i] AS w1, t[i + 1] AS w2 FROM (SELECT *, unnest(range(1, len(t))) AS i FROM pt WHERE len(t) >= 4)),
mt AS (SELECT doc_id, p_idx, count(*) AS n, avg(p) AS a FROM pb JOIN lm USING (w1, w2) GROUP BY ALL)
SELECT doc_id, p_idx, CASE WHEN n >= 3 THEN round(a, 6) ELSE -1.0::DOUBLE END AS avg_prob FROM par LEFT JOIN mt USING (doc_id, p_idx)""")
def _(spark, d):
    model = M.bigram_model(spark.read.parquet(f"{d}/benchmark.parquet"), LATIN)
    return M.average_probability(par(spark, d), model, LATIN).select("doc_id", "p_idx", *rounded("avg_prob"))


_GRAMS = r"""list_filter(flatten(list_transform(string_split_regex(trim(regexp_replace(lower({x}), '[ \t\r\n]+', ' ', 'g')), ' '), lambda w: flatten(list_transform([2, 3, 4],
  lambda n: CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) + 2 <= n THEN CASE WHEN n = 2 OR len(w) + 2 > n - 1 THEN [' ' || w || ' '] ELSE CAST([] AS VARCHAR[]) END
                 ELSE list_transform(range(1, len(w) + 4 - n), lambda i: substr(' ' || w || ' ', i, n)) END)))), lambda g: len(g) > 0)"""
_TFIDF = f"""rg AS (SELECT item_id, unnest({_GRAMS.format(x="text")}) AS g FROM benchmark),
rt AS (SELECT item_id, g, count(*) AS tf FROM rg GROUP BY ALL),
vc AS (SELECT g, sum(tf) AS total, count(*) AS df FROM rt GROUP BY g QUALIFY row_number() OVER (ORDER BY sum(tf) DESC, g) <= 5000),
vi AS (SELECT g, ln((1 + (SELECT count(*) FROM benchmark))::DOUBLE / (1 + df)) + 1 AS idf FROM vc),
rw0 AS (SELECT item_id, g, tf * idf AS w FROM rt JOIN vi USING (g)),
rw AS (SELECT item_id, g, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM rw0)"""


@query("char_tfidf_model", f"WITH {_TFIDF} SELECT g AS gram, round(idf, 6) AS idf FROM vi")
def _(spark, d):
    return M.char_model(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id")[0].select("gram", *rounded("idf"))


@query("char_tfidf_best_match", f"""WITH {_TFIDF}, sg AS (SELECT conv_id, turn, unnest({_GRAMS.format(x="text")}) AS g FROM conversations WHERE len(text) >= 10),
s0 AS (SELECT conv_id, turn, g, count(*) * any_value(idf) AS w FROM sg JOIN vi USING (g) GROUP BY ALL),
sw AS (SELECT conv_id, turn, g, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)) AS w FROM s0),
sm AS (SELECT conv_id, turn, item_id, sum(sw.w * rw.w) AS c FROM sw JOIN rw USING (g) GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(max(c), 0.0::DOUBLE), 6) AS similarity FROM conversations LEFT JOIN sm USING (conv_id, turn) GROUP BY ALL""")
def _(spark, d):
    vocabulary, weights = M.char_model(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id")
    rows = spread(spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text"))
    return M.best_match(rows, ["conv_id", "turn"], vocabulary, weights).select("conv_id", "turn", *rounded("similarity"))


TOLD = f"""{_LM}, {_TFIDF}, pt AS (SELECT doc_id, p_idx, {S.tokens("text", LATIN)} AS t FROM par),
pb AS (SELECT doc_id, p_idx, t[i] AS w1, t[i + 1] AS w2 FROM (SELECT *, unnest(range(1, len(t))) AS i FROM pt WHERE len(t) >= 4)),
mt AS (SELECT doc_id, p_idx, count(*) AS n, avg(p) AS a FROM pb JOIN lm USING (w1, w2) GROUP BY ALL),
sg AS (SELECT par.doc_id, par.p_idx, CASE WHEN coalesce(n, 0) < 3 THEN -1.0 WHEN a > 0.25 THEN 0.1 WHEN a > 0.12 THEN 0.06 WHEN a > 0.05 THEN 0.02 ELSE 0 END::DOUBLE AS b FROM par LEFT JOIN mt USING (doc_id, p_idx)),
xg AS (SELECT doc_id, p_idx, s_idx, unnest({_GRAMS.format(x="sentence")}) AS g FROM sent WHERE len(sentence) >= 10),
x0 AS (SELECT doc_id, p_idx, s_idx, g, count(*) * any_value(idf) AS w FROM xg JOIN vi USING (g) GROUP BY ALL),
xw AS (SELECT doc_id, p_idx, s_idx, g, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, p_idx, s_idx)) AS w FROM x0),
xm AS (SELECT doc_id, p_idx, s_idx, item_id, sum(xw.w * rw.w) AS c FROM xw JOIN rw USING (g) GROUP BY ALL),
ck AS (SELECT doc_id, p_idx, s_idx, max(c) AS c FROM xm GROUP BY ALL),"""
TOLD_JOINS = "JOIN sg ON sg.doc_id = st.doc_id AND sg.p_idx = st.p_idx LEFT JOIN ck ON ck.doc_id = st.doc_id AND ck.p_idx = st.p_idx AND ck.s_idx = st.s_idx"
_LIKE = "CASE WHEN coalesce(ck.c, 0) > 0.5 THEN 0.4 WHEN coalesce(ck.c, 0) > 0.3 THEN 0.22 ELSE 0 END::DOUBLE"
_ALL_SIGNALS = zones_sql(LATIN, more=_LIKE, joins=TOLD_JOINS, before=TOLD, bigram="sg.b")


def told_by_models(spark, d, rows):
    """Signals of paragraphs and likeness of sentences, by models of the benchmark's texts."""
    refs = spark.read.parquet(f"{d}/benchmark.parquet")
    avg = M.average_probability(rows, M.bigram_model(refs, LATIN), LATIN)
    keys = ["doc_id", "p_idx", "s_idx"]
    like = M.best_match(P.sentences(rows, LATIN).select(*keys, F.col("sentence").alias("text")), keys, *M.char_model(refs, "item_id"))
    return avg.select("doc_id", "p_idx", "avg_prob", T.bigram_signal(F.col("avg_prob")).alias("bigram")), like


@query("sentence_zones_all_signals", f"WITH {TALK}, {_ALL_SIGNALS}, {SPREAD} SELECT doc_id, p_idx, s_idx, round(score, 4) AS score, zone FROM zp")
def _(spark, d):
    """Conversations with every signal that needs no vectors: the models come from the benchmark's texts."""
    rows = talk(spark, d)
    zones = T.propagated(T.zones_raw(rows, LATIN, *told_by_models(spark, d, rows)))
    return zones.select("doc_id", "p_idx", "s_idx", F.round("score", 4).alias("score"), "zone")


@query("document_ai_rate_all_signals", f"WITH {TALK}, {_ALL_SIGNALS}, {SPREAD}, sm AS ({SUMMARY}) SELECT *, CASE WHEN ai_rate > 0.4 THEN 'high' WHEN ai_rate > 0.15 THEN 'partial' ELSE 'safe' END AS verdict FROM sm")
def _(spark, d):
    """The rate and verdict of conversations, with those signals."""
    rows = talk(spark, d)
    out = T.document_summary(T.propagated(T.zones_raw(rows, LATIN, *told_by_models(spark, d, rows)))).withColumn("ai_rate", F.round("ai_rate", 6))
    return out.withColumn("verdict", T.verdict(F.col("ai_rate")))

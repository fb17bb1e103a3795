"""Queries on reports, protected spans, the classifier and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.packs import LATIN, ZH
from ..operators import compare
from ..operators import dimensions as D
from ..operators import fusion as U
from ..operators import parse as P
from ..operators import phrases
from ..operators import scoring as C
from ..operators import sentences as T
from ..operators import spans as X
from ..sources import files, readers, sinks
from ..sources.stored import place, stored
from ..streaming import paragraphs, scan
from . import sql as S
from .paragraph_queries import PAR, TALK, ZPAR, documents, par, rounded, talk, zh_docs
from .sentence_queries import SPREAD, SUMMARY, TOLD, TOLD_JOINS, formula_sql, self_sql, sent_sql, shared_sql, starter_sql, stats_sql, told_by_models, zones_sql
from .vector_queries import FUSED_LEVEL_SQL, GAPS, SEMANTIC, SENTENCE_VECTORS, told_by_vectors

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_LABELS = list(dict.fromkeys(x for _, x in X.PATTERNS))
_COUNT = lambda x: " + ".join(f"len(regexp_extract_all(text, {S.q(p)}))" for p, y in X.PATTERNS if y == x)


@query("protected_label_counts", "WITH " + PAR + " " + " UNION ALL ".join(f"SELECT '{x}' AS label, CAST(sum({_COUNT(x)}) AS BIGINT) AS n FROM par" for x in _LABELS))
def _(spark, d):
    return X.label_counts(par(spark, d))


@query("protected_spans", None)
def _(spark, d):
    rows = X.protected(par(spark, d))
    return rows.select("doc_id", "p_idx", F.explode("protected_spans").alias("s")).select("doc_id", "p_idx", "s.*")


@query("mask_roundtrip", None)
def _(spark, d):
    rows = X.restored(X.masked(X.protected(par(spark, d))))
    return rows.select("doc_id", "p_idx", "masked_text", (F.col("restored_text") == F.col("text")).alias("same"))


@query("report_summary", f"WITH {PAR}, {S.dims(LATIN)}, {S.classified()} SELECT count(*) AS total_paragraphs, count(*) FILTER (level IN ('red', 'deep_red')) AS high_risk, count(*) FILTER (level = 'yellow') AS suspicious, count(*) FILTER (level = 'green') AS safe FROM cls")
def _(spark, d):
    return sinks.report_summary(D.scanned(par(spark, d), LATIN))


_GAP_LIST = "list({'dimension': dim, 'gap': gap, 'zone': zone} ORDER BY gap DESC, dim_ord)"


@query("json_report", f"""WITH {PAR}, {S.dims(LATIN)}, {S.classified()}, {S.unpivoted()}, g AS (SELECT doc_id, p_idx, {_GAP_LIST} AS ranked_gaps FROM lng WHERE zone = 'ai' GROUP BY ALL)
SELECT doc_id, p_idx, CAST(to_json({{'index': p_idx, 'text_preview': left(text, 200), 'level': level, 'comprehensive_score': round(comprehensive_score, 4), 'ranked_gaps': coalesce(ranked_gaps, [])}}) AS VARCHAR) AS json FROM cls LEFT JOIN g USING (doc_id, p_idx)""")
def _(spark, d):
    return sinks.json_rows(D.scanned(par(spark, d), LATIN))


_PARAGRAPH_OBJECTS = f"""{S.dims(LATIN)}, {S.classified()}, {S.unpivoted()}, g AS (SELECT doc_id, p_idx, {_GAP_LIST} AS ranked_gaps FROM lng WHERE zone = 'ai' GROUP BY ALL),
jr AS (SELECT doc_id, p_idx, level, CAST(to_json({{'index': p_idx, 'text_preview': left(text, 200), 'level': level, 'comprehensive_score': round(comprehensive_score, 4), 'ranked_gaps': coalesce(ranked_gaps, [])}}) AS VARCHAR) AS json FROM cls LEFT JOIN g USING (doc_id, p_idx))"""


@query("report_files", f"""WITH {TALK}, {_PARAGRAPH_OBJECTS} SELECT doc_id, '{{"summary":{{"total_paragraphs":' || count(*) || ',"high_risk":' || count(*) FILTER (level IN ('red', 'deep_red')) || ',"suspicious":' || count(*) FILTER (level = 'yellow') || ',"safe":' || count(*) FILTER (level = 'green') || '}},"paragraphs":[' || string_agg(json, ',' ORDER BY p_idx) || ']}}' AS json FROM jr GROUP BY doc_id""")
def _(spark, d):
    """Each conversation's report written as a file by tasks, published by a manifest, and read back."""
    levels, path = stored(D.scanned(talk(spark, d), LATIN), "levels"), place(spark, "reports")
    files.register(spark)
    rows = sinks.document_json(sinks.json_rows(levels), levels)
    rows.select(F.col("doc_id").cast("string").alias("name"), F.col("json").alias("text")).write.format("textfiles").option("extension", ".json").mode("append").save(path)
    return spark.read.format("textfiles").load(path).filter("error IS NULL").select(F.col("name").cast("long").alias("doc_id"), F.col("text").alias("json"))


@query("text_files", "SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents")
def _(spark, d):
    """All documents as text files and back, by the data source."""
    path = place(spark, "texts")
    files.register(spark)
    documents(spark, d).select(F.col("doc_id").cast("string").alias("name"), "text").write.format("textfiles").mode("append").save(path)
    return spark.read.format("textfiles").load(path).select(F.col("name").cast("long").alias("doc_id"), "text", "n_bytes")


def _escaped_sql(x: str) -> str:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {S.q(sign)}, {S.q(name)})"
    return x


_CASE = lambda pairs: "CASE level " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in pairs.items()) + " END"
_SECTION = f"'<section style=''border-left:4px solid ' || {_CASE(sinks.COLOURS)} || '''><h2>' || p_idx || ': ' || {_CASE(sinks.LABELS)} || ' (' || printf('%.4f', round(comprehensive_score, 4)) || ')</h2><p>' || {_escaped_sql('text')} || '</p></section>'"
_HEAD = "'<!DOCTYPE html><html><head><meta charset=''utf-8''><title>Report</title></head><body><h1>Report ' || doc_id || '</h1>'"


@query("html_documents", f"WITH {PAR}, {S.dims(LATIN)}, {S.classified()} SELECT doc_id, {_HEAD} || string_agg({_SECTION}, chr(10) ORDER BY p_idx) || '</body></html>' AS html FROM cls GROUP BY doc_id")
def _(spark, d):
    return sinks.html_documents(D.scanned(par(spark, d), LATIN))


@query("rewrite_prompt", f"WITH {PAR}, {zones_sql(LATIN)}, {SPREAD} SELECT doc_id, p_idx, string_agg('[' || zp.zone || '] ' || zr.sentence, chr(10) ORDER BY s_idx) AS prompt FROM zp JOIN zr USING (doc_id, p_idx, s_idx) WHERE zp.zone <> 'green' GROUP BY ALL")
def _(spark, d):
    return sinks.rewrite_prompt(T.propagated(T.zones_raw(par(spark, d), LATIN)))


@query("nested_report", f"""WITH {TALK}, {S.scanned(LATIN)}, {SEMANTIC}, sa AS (SELECT doc_id, p_idx, count(*) FILTER (zone = 'ai') AS s FROM sem GROUP BY ALL),
zz AS (WITH {zones_sql(LATIN)}, {SPREAD} SELECT zp.doc_id, zp.p_idx, zp.s_idx, zr.sentence, zp.zone, round(zp.score, 4) AS score FROM zp JOIN zr USING (doc_id, p_idx, s_idx)),
nn AS (SELECT doc_id, p_idx, count(*) FILTER (zone IN ('red', 'orange')) AS ai, count(*) AS n, to_json(list({{'s_idx': s_idx, 'sentence': sentence, 'zone': zone, 'score': score}} ORDER BY s_idx)) AS sentences FROM zz GROUP BY ALL)
SELECT cls.doc_id, cls.p_idx,
  CASE WHEN s IS NULL THEN level WHEN ai_count + s >= 10 THEN 'deep_red' WHEN ai_count + s >= 6 THEN 'red' WHEN ai_count + s >= 3 THEN 'yellow' WHEN level IN ('red', 'deep_red') THEN 'red' WHEN level = 'yellow' THEN 'yellow' ELSE 'green' END AS level,
  CAST(round(100 * CASE WHEN s IS NULL THEN comprehensive_score ELSE (ai_count + s)::DOUBLE / 16 END) AS INTEGER) AS score, coalesce(ai, 0) AS ai_sentence_count, CAST(coalesce(n, 0) AS INTEGER) AS total_sentence_count, CAST(sentences AS VARCHAR) AS sentences
FROM cls LEFT JOIN sa USING (doc_id, p_idx) LEFT JOIN nn USING (doc_id, p_idx)""")
def _(spark, d):
    rows = talk(spark, d)
    return sinks.nested_report(T.propagated(T.zones_raw(rows, LATIN)), U.together(rows, LATIN)).withColumn("sentences", F.to_json("sentences"))


@query("api_scan_counts", f"WITH {TALK}, {zones_sql(LATIN)}, {SPREAD} SELECT par.doc_id, par.p_idx, count(zp.s_idx) AS sentences, count(*) FILTER (zone IN ('red', 'orange')) AS ai_sentence_count FROM par LEFT JOIN zp ON zp.doc_id = par.doc_id AND zp.p_idx = par.p_idx GROUP BY ALL")
def _(spark, d):
    rows = talk(spark, d)
    zones = T.propagated(T.zones_raw(rows, LATIN)).groupBy("doc_id", "p_idx").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(F.col("zone").isin("red", "orange")).alias("ai_sentence_count"))
    return rows.select("doc_id", "p_idx").join(zones, ["doc_id", "p_idx"], "left").na.fill(0)


_ZH_LEXICON = "lx AS (SELECT * FROM (VALUES " + ", ".join(f"({S.q(a)}, {S.q(b)}, {S.q(c)})" for a, b, c in [("connector", level, p) for level, own in ZH.connectors.items() for p in own] + [("slop", level, p) for level, own in ZH.slop.items() for p in own] + [("stopword", "", w) for w in ZH.stopwords]) + ") t(lexicon, level, phrase))"
_TIMES = "(len(text) - len(replace(text, phrase, ''))) // len(phrase)"


@query("lexicons", f"WITH {ZPAR}, {_ZH_LEXICON}, f AS (SELECT phrase, CAST(sum({_TIMES}) AS BIGINT) AS n FROM par, (SELECT DISTINCT phrase FROM lx) WHERE contains(text, phrase) GROUP BY phrase) SELECT lexicon, level, phrase, coalesce(n, 0) AS n FROM lx LEFT JOIN f USING (phrase)")
def _(spark, d):
    """The Chinese pack's expressions and how often each stands in the texts."""
    rows, own = P.paragraphs(zh_docs(spark, d), ZH), readers.lexicon(spark, ZH)
    n = phrases.counted(rows, ["doc_id", "p_idx"], own).groupBy("phrase").agg(F.sum("n").alias("n"))
    return own.join(n, "phrase", "left").select("lexicon", "level", "phrase", F.coalesce("n", F.lit(0)).alias("n"))


#: Every pair of neighbouring words of the benchmark's items, by the length of its first word: a lexicon of thousands of phrases that grows with the table.
_PAIRS = "lx AS (SELECT DISTINCT 'pairs' AS lexicon, CASE WHEN instr(phrase, ' ') > 5 THEN 'long' ELSE 'short' END AS level, phrase FROM (SELECT w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(text, ' ') AS w FROM benchmark))) WHERE len(phrase) >= 8)"


def _pairs(spark, d):
    w = spark.read.parquet(f"{d}/benchmark.parquet").select(F.split("text", " ").alias("w"))
    two = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1)))
    own = w.filter(F.size("w") > 1).select(F.explode(two).alias("phrase")).filter(F.length("phrase") >= 8).distinct()
    return own.select(F.lit("pairs").alias("lexicon"), F.when(F.instr("phrase", " ") > 5, "long").otherwise("short").alias("level"), "phrase")


@query("lexicon_counts", f"WITH {TALK}, {_PAIRS} SELECT doc_id, p_idx, phrase, CAST({_TIMES} AS BIGINT) AS n FROM par JOIN lx ON contains(text, phrase)")
def _(spark, d):
    return phrases.counted(talk(spark, d), ["doc_id", "p_idx"], _pairs(spark, d))


@query("lexicon_densities", f"WITH {TALK}, {_PAIRS} SELECT doc_id, p_idx, lexicon, level, CAST(sum({_TIMES}) AS BIGINT) AS n, count(*) AS hits, round(1000 * sum({_TIMES})::DOUBLE / any_value(len(text)), 6) AS density FROM par JOIN lx ON contains(text, phrase) GROUP BY doc_id, p_idx, lexicon, level")
def _(spark, d):
    return phrases.densities(talk(spark, d), ["doc_id", "p_idx"], _pairs(spark, d)).withColumn("density", F.round("density", 6))


_HIT = lambda own: f"least({S.hits('sentence', own)} / 3.0::DOUBLE, 1.0::DOUBLE)"
_FEATURES = {
    "lexical_diversity": "lexical_diversity", "char_entropy": "least(char_entropy / 8, 1.0::DOUBLE)", "word_repetition": "least(word_repetition / 5.0::DOUBLE, 1.0::DOUBLE)", "unique_char_ratio": "unique_char_ratio", "char_similarity": "CASE WHEN chars >= 10 THEN coalesce(ck.c, 0) ELSE 0 END::DOUBLE",
    "high_connectors": _HIT(LATIN.connectors["high"]), "medium_connectors": _HIT(LATIN.connectors["medium"]), "low_connectors": _HIT(LATIN.connectors["low"]), "slop": f"CASE WHEN {S.hits('sentence', LATIN.all_slop)} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "template": "least(template / 0.4::DOUBLE, 1.0::DOUBLE)", "parallel_starter": f"CASE WHEN {starter_sql('sentence', LATIN)} IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "formula": f"CASE WHEN {formula_sql('sentence', LATIN)} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "even_lengths": "least(even / 0.1::DOUBLE, 1.0::DOUBLE)", "place": "CASE WHEN st.s_idx = 0 THEN 1.0 WHEN st.s_idx = n_sents - 1 THEN 0.6 ELSE 0 END::DOUBLE", "uniform": "least(coalesce(sv2.un, 0) / 0.14::DOUBLE, 1.0::DOUBLE)",
    "level": "CASE level WHEN 'deep_red' THEN 1.0 WHEN 'red' THEN 0.7 WHEN 'yellow' THEN 0.4 ELSE 0 END::DOUBLE", "bigram": "least(sg.b / 0.1::DOUBLE, 1.0::DOUBLE)", "own": "least(ow.o / 0.15::DOUBLE, 1.0::DOUBLE)", "human": "least(sv2.hu / 0.16::DOUBLE, 1.0::DOUBLE)",
}


_ALL_FEATURES = f"""{sent_sql(LATIN)}, {TOLD} {SENTENCE_VECTORS} {S.scanned(LATIN, False)}, {stats_sql(LATIN)}, {shared_sql(LATIN)}, {self_sql(LATIN)},
ft AS (SELECT st.doc_id, st.p_idx, st.s_idx, chars, in_references, {", ".join(f"{v} AS {k}" for k, v in _FEATURES.items())} FROM st JOIN psig USING (doc_id, p_idx) JOIN cls USING (doc_id, p_idx) JOIN ow USING (doc_id, p_idx)
  JOIN sv2 ON sv2.doc_id = st.doc_id AND sv2.p_idx = st.p_idx {TOLD_JOINS} WHERE chars >= 5)"""


def _told(spark, d, rows):
    """All signals of models and vectors: of paragraphs, and of sentences."""
    pairs, like = told_by_models(spark, d, rows)
    return pairs.join(told_by_vectors(spark, d, rows), ["doc_id", "p_idx"], "full"), like


@query("sentence_features", f"WITH {TALK}, {_ALL_FEATURES} SELECT doc_id, p_idx, s_idx, {', '.join(f'round({k}, 6) AS {k}' for k in _FEATURES)} FROM ft")
def _(spark, d):
    """The sentences of conversations, with all nineteen."""
    from pyspark.ml.functions import vector_to_array

    rows = talk(spark, d)
    found = C.features(rows, LATIN, *_told(spark, d, rows)).withColumn("f", vector_to_array("features"))
    return found.select("doc_id", "p_idx", "s_idx", *(F.round(F.col("f")[k], 6).alias(n) for k, n in enumerate(C.FEATURES)))


#: A small forest that is given, not learnt, so that SQL can have it too; of rules that the features' meanings suggest.
_AT = {n: k for k, n in enumerate(C.FEATURES)}
GIVEN = [
    (_AT["char_similarity"], 0.3, (_AT["own"], 0.3, (_AT["level"], 0.5, 0.08, 0.31), 0.47), (_AT["bigram"], 0.2, 0.62, 0.86)),
    (_AT["lexical_diversity"], 0.93, (_AT["char_entropy"], 0.47, 0.74, (_AT["place"], 0.5, 0.36, 0.52)), (_AT["unique_char_ratio"], 0.35, 0.55, 0.14)),
    (_AT["uniform"], 0.5, (_AT["human"], 0.5, (_AT["even_lengths"], 0.5, 0.11, 0.42), (_AT["word_repetition"], 0.3, 0.28, 0.66)), 0.78),
    (_AT["medium_connectors"], 0.3, (_AT["slop"], 0.5, (_AT["unique_char_ratio"], 0.45, 0.49, 0.2), 0.9), (_AT["high_connectors"], 0.3, 0.58, 0.81)),
]
_P = f"({' + '.join(['0.0::DOUBLE', *(C.tree_sql(t, list(_FEATURES)) for t in GIVEN)])}) / {float(len(GIVEN))!r}::DOUBLE"
_MODEL_ZONES = f"""{_ALL_FEATURES}, pr AS (SELECT doc_id, p_idx, s_idx, chars, in_references, {_P} AS p FROM ft),
zr AS (SELECT doc_id, p_idx, s_idx, chars, CASE WHEN in_references THEN 0.0::DOUBLE ELSE p END AS score,
  CASE WHEN in_references THEN 'green' WHEN round(p, 6) >= {C.CUTS[0]} THEN 'red' WHEN round(p, 6) >= {C.CUTS[1]} THEN 'orange' WHEN round(p, 6) >= {C.CUTS[2]} THEN 'yellow' ELSE 'green' END AS zone FROM pr), {SPREAD}"""


def _model_zones(spark, d):
    rows = talk(spark, d)
    return T.zones_raw(rows, LATIN, *_told(spark, d, rows), model=C.Detector.of(GIVEN))


@query("model_zones", f"WITH {TALK}, {_MODEL_ZONES} SELECT zp.doc_id, zp.p_idx, zp.s_idx, round(zp.score, 6) AS score, zp.zone, CASE WHEN zp.s_idx = 0 AND NOT in_references THEN 'ML(' || printf('%.0f', 100 * p) || '%)' END AS said FROM zp JOIN pr USING (doc_id, p_idx, s_idx)")
def _(spark, d):
    """A forest as the main detector of a scan: its zones after the latch and the spread, and what it says of first sentences."""
    zones = T.propagated(_model_zones(spark, d))
    return zones.select("doc_id", "p_idx", "s_idx", F.round("score", 6).alias("score"), "zone", F.get(F.filter("reasons", lambda r: r.startswith("ML(")), F.lit(0)).alias("said"))


@query("model_ai_rate", f"WITH {TALK}, {_MODEL_ZONES}, sm AS ({SUMMARY}) SELECT * FROM sm JOIN (SELECT doc_id, round(sum(chars * CASE zone WHEN 'red' THEN 1.0 WHEN 'orange' THEN 0.7 WHEN 'yellow' THEN 0.4 ELSE 0 END::DOUBLE) / sum(chars), 6) AS weighted_rate FROM zp GROUP BY doc_id) USING (doc_id)")
def _(spark, d):
    """The rates of conversations by that forest."""
    zones = stored(T.propagated(_model_zones(spark, d)).select("doc_id", "chars", "zone"), "zones")
    weighted = C.Detector.of(GIVEN).weighted_rate(zones).withColumn("weighted_rate", F.round("weighted_rate", 6))
    return T.document_summary(zones).withColumn("ai_rate", F.round("ai_rate", 6)).join(weighted, "doc_id")


@query("rf_score", None)
def _(spark, d):
    """A forest taught to tell sentences of documents of low quality, but those of a fifth of the documents, then used on all."""
    rows = stored(C.features(par(spark, d), LATIN), "features").withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0)
    labels = spark.read.parquet(f"{d}/labels.parquet").filter("quality IS NOT NULL").select("doc_id", (1.0 - F.col("quality")).alias("label"))
    model = C.train(rows.filter("NOT held_out").join(labels, "doc_id"))
    return C.Detector.of(model).transform(rows).select("doc_id", "p_idx", "s_idx", "held_out", *rounded("probability"), "zone")


@query("stream_scan", f"WITH {PAR}, {S.dims(LATIN)}, {S.classified()} SELECT doc_id, p_idx, ai_count, level FROM cls")
def _(spark, d):
    return scan.drained(scan.levels(scan.table_stream(spark, d, "documents")))


def _turn_stream(spark, d):
    ends = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.max("turn").alias("end"))
    return paragraphs.turns(scan.table_stream(spark, d, "conversations"), ends)


@query("stream_sentence_zones", f"WITH {TALK}, {zones_sql(LATIN)}, {SPREAD} SELECT doc_id, p_idx, s_idx, chars, round(score, 6) AS score, zone FROM zp")
def _(spark, d):
    """Conversations as a stream of turns: latch and spread as state of each conversation."""
    return scan.drained(paragraphs.zones(_turn_stream(spark, d))).withColumn("score", F.round("score", 6))


@query("stream_paragraph_levels", f"WITH {TALK}, {S.scanned(LATIN)} SELECT doc_id, p_idx, ai_count, level, round(comprehensive_score, 6) AS comprehensive_score FROM cls")
def _(spark, d):
    """Conversations as a stream of turns: each turn's statistics with the turn before it as state."""
    return scan.drained(paragraphs.levels(_turn_stream(spark, d))).withColumn("comprehensive_score", F.round("comprehensive_score", 6))


@query("stream_event_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    rows = scan.drained(scan.event_counts(scan.table_stream(spark, d, "events")), ("day", "event_type"))
    return rows.withColumn("total", F.round("total", 4))


@query("before_after", f"""WITH {PAR}, {S.scanned(LATIN)}, b AS (SELECT doc_id, p_idx, level AS level_before FROM cls),
a AS (SELECT doc_id, p_idx, level AS level_after FROM (WITH {S.paragraphs(LATIN, "(SELECT doc_id, replace(text, '. ', '.' || chr(10)) AS text FROM documents)")}, {S.scanned(LATIN)} SELECT * FROM cls))
SELECT doc_id, p_idx, level_before, level_after, CASE WHEN level_before IS NULL THEN 'added' WHEN level_after IS NULL THEN 'removed' WHEN y.k < x.k THEN 'better' WHEN y.k > x.k THEN 'worse' ELSE 'same' END AS change
FROM b FULL JOIN a USING (doc_id, p_idx) LEFT JOIN (VALUES ('green', 0), ('yellow', 1), ('red', 2), ('deep_red', 3)) x(z, k) ON x.z = level_before LEFT JOIN (VALUES ('green', 0), ('yellow', 1), ('red', 2), ('deep_red', 3)) y(z, k) ON y.z = level_after""")
def _(spark, d):
    """The documents against themselves with each sentence on a line of its own."""
    docs = documents(spark, d)
    again = docs.select("doc_id", F.replace(F.col("text"), F.lit(". "), F.lit(".\n")).alias("text"))
    before = D.scanned(par(spark, d), LATIN).select("doc_id", "p_idx", F.col("level").alias("fused_level"))
    return compare.compared(before, D.scanned(P.paragraphs(again, LATIN), LATIN))


_NEW = "Put in before all others by the one who wrote it again."
_RANKS = "(VALUES ('green', 0), ('yellow', 1), ('red', 2), ('deep_red', 3))"


@query("before_after_aligned", f"""WITH {PAR}, {S.scanned(LATIN)}, b AS (SELECT doc_id, p_idx, level FROM cls),
a AS (SELECT doc_id, p_idx, level FROM (WITH {S.paragraphs(LATIN, f"(SELECT doc_id, {S.q(_NEW)} || chr(10) || coalesce(text, '') AS text FROM documents)")}, {S.scanned(LATIN)} SELECT * FROM cls)),
m AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, b.p_idx AS p_before, a.p_idx AS p_after, b.level AS level_before, a.level AS level_after FROM b FULL JOIN a ON a.doc_id = b.doc_id AND a.p_idx = b.p_idx + 1)
SELECT doc_id, p_before, p_after, level_before, level_after, CASE WHEN level_before IS NULL THEN 'added' WHEN level_after IS NULL THEN 'removed' WHEN y.k < x.k THEN 'better' WHEN y.k > x.k THEN 'worse' ELSE 'same' END AS change
FROM m LEFT JOIN {_RANKS} x(z, k) ON x.z = level_before LEFT JOIN {_RANKS} y(z, k) ON y.z = level_after""")
def _(spark, d):
    """The documents against themselves with a paragraph put in before all others: it is added, and every other meets itself."""
    docs = documents(spark, d)
    again = docs.select("doc_id", F.concat(F.lit(_NEW + "\n"), F.coalesce("text", F.lit(""))).alias("text"))
    before = D.scanned(par(spark, d), LATIN).withColumnRenamed("level", "fused_level")
    return compare.aligned(before, D.scanned(P.paragraphs(again, LATIN), LATIN))


@query("refusals", f"""WITH {PAR}, h AS (SELECT DISTINCT doc_id FROM par) SELECT d.doc_id, CASE WHEN len(trim(coalesce(text, ''))) < 20 THEN '文本太短' WHEN h.doc_id IS NULL THEN '未检测到有效段落' END AS error FROM documents d LEFT JOIN h USING (doc_id)""")
def _(spark, d):
    return sinks.refusals(documents(spark, d), par(spark, d))


_FUSED_OBJECT = """{'paragraph_index': p_idx, 'rule_level': level, 'rule_ai_count': ai_count, 'rule_gray_count': gray_count, 'semantic_ai_count': CAST(coalesce(s, 0) AS INTEGER), 'total_dimensions': CASE WHEN s IS NULL THEN 12 ELSE 16 END,
  'combined_ai_count': CAST(ai_count + coalesce(s, 0) AS INTEGER), 'rule_score': round(comprehensive_score, 4), 'combined_score': round(CASE WHEN s IS NULL THEN comprehensive_score ELSE (ai_count + s)::DOUBLE / 16 END, 4),
  'fused_level': fused_level, 'gaps': coalesce(gaps, [])}"""


@query("fused_json", f"""{GAPS}, sa AS (SELECT doc_id, p_idx, count(*) FILTER (zone = 'ai') AS s FROM sem GROUP BY ALL), {FUSED_LEVEL_SQL},
gl AS (SELECT doc_id, p_idx, list({{'dimension': dim, 'description': description, 'value': round(value, 6), 'gap': round(gap, 6), 'layer': layer}} ORDER BY rank) AS gaps FROM gr GROUP BY ALL)
SELECT doc_id, p_idx, CAST(to_json({_FUSED_OBJECT}) AS VARCHAR) AS json FROM cls JOIN fz USING (doc_id, p_idx) LEFT JOIN sa USING (doc_id, p_idx) LEFT JOIN gl USING (doc_id, p_idx)""")
def _(spark, d):
    return sinks.fused_json(U.together(talk(spark, d), LATIN))

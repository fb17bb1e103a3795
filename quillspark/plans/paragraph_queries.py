"""Queries on paragraphs: parsing, statistics, levels, guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packs import LATIN, ZH
from ..functions.thresholds import RULE_DIMENSIONS
from ..operators import dimensions as D
from ..operators import parse as P
from ..sources.readers import spread
from . import sql as S

#: Words that stand for those of a conversation in its Chinese rendering; this library's own.
ZH_PLAIN = (
    "城市 治理 数据 平台 制度 结构 乡村 教育 技术 政策 企业 市场 成本 效率 风险 居民 服务 资源 环境 文化 历史 语言 网络 模型 算法 系统 过程 方法 问题 结果 影响 变化 关系 行为 态度 认知 时间 空间 学生 教师 课程 "
    "实验 样本 指标 变量 假设 证据 观点 案例 材料 部门 机构 项目 目标 条件 机制 路径 能力 水平 规模 比例 增长 减少 提高 降低 比较 调查 访谈 观察 记录 整理 讨论 说明 发现 认为 表明 显示 选择 参与 合作 竞争 分配 "
    "协调 监督 评价 改进 推广 学习 理解 表达 交流 传播 人工智能 研究者 方法论 可持续 公共服务 基础设施 信息技术 夜里 窗外 灯火 街道 河边 朋友 母亲 孩子 故事 声音 颜色 春天 雨水 山路 早晨"
).split()
ZH_SIGNS = ["我觉得", "我的心", "难道", "仿佛", "不禁", "像星星一样", "笑着，", "走着，", "看着，", "下去，", "本文从制度角度分析", "通过比较使结论", "从效率来看", "从整体来看", "一方面", "另一方面", "不仅", "通过", "借助", "将", "最终表明", "\n参考文献\n"]
ZH_SPECIAL = [*ZH.all_connectors, *(x for x in ZH.all_slop if "." not in x), *ZH_SIGNS]
#: A word's hash modulo this number is its place among the special expressions; beyond those, a plain word stands for it.
ZH_ROOM = 1499
ZH_MARKS = ".,!?;", "。，！？；"

ZH_SQL = f"""
zw AS (SELECT conv_id, turn, i, w[i] AS w, CAST('0x' || substr(md5(w[i]), 1, 6) AS BIGINT) AS h FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))),
zt AS (SELECT conv_id, turn, string_agg(CASE WHEN h % {ZH_ROOM} < {len(ZH_SPECIAL)} THEN {S.words(ZH_SPECIAL)}[h % {ZH_ROOM} + 1] ELSE {S.words(ZH_PLAIN)}[h % {len(ZH_PLAIN)} + 1] END || translate(regexp_extract(w, '[{ZH_MARKS[0]}]$'), '{ZH_MARKS[0]}', '{ZH_MARKS[1]}'), '' ORDER BY i) AS text FROM zw GROUP BY ALL),
zh AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM zt GROUP BY conv_id)"""


def zh_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: each conversation put into Chinese word by word, a turn a paragraph. The tables have no Chinese text; this one brings all of the pack to bear."""
    rows = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"))
    special, plain = F.array(*map(F.lit, ZH_SPECIAL)), F.array(*map(F.lit, ZH_PLAIN))

    def word(w):
        h = F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int")
        put = F.when(h % ZH_ROOM < len(ZH_SPECIAL), F.get(special, h % ZH_ROOM)).otherwise(F.get(plain, h % len(ZH_PLAIN)))
        return F.concat(put, F.translate(F.regexp_extract(w, f"[{ZH_MARKS[0]}]$", 0), *ZH_MARKS))

    turns = rows.select("conv_id", "turn", F.array_join(F.transform(F.split("text", " "), word), "").alias("text"))
    # dealt before they are put together, over as many tasks as counting needs: their bytes alone would give a few
    whole = spread(turns, "conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return whole.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


def documents(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key)


def par(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.paragraphs(documents(spark, sf_dir), LATIN)


def par_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are dealt by their ids before they are cut; so the window of the references moves no row again. What is counted later moves once more where zones spread."""
    return P.paragraphs(documents(spark, sf_dir, "doc_id"), LATIN)


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ordered_paragraphs(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"), "conv_id"), "conv_id", "turn")


PAR, ZPAR, TALK = S.paragraphs(LATIN), ZH_SQL + "," + S.paragraphs(ZH, "zh"), S.turns()
NAMES = [d[0] for d in RULE_DIMENSIONS]
rounded = lambda *names: [F.round(n, 6).alias(n) for n in names]
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("parse_paragraphs", f"WITH {PAR} SELECT doc_id, p_idx, text, CAST(len(text) AS INTEGER) AS char_count FROM par")
def _(spark, d):
    return par(spark, d).select("doc_id", "p_idx", "text", F.length("text").alias("char_count"))


@query("split_sentences", f"""WITH {PAR}, s AS (SELECT doc_id, p_idx, {S.sentence_list("text", LATIN)} AS ss FROM par)
SELECT doc_id, p_idx, CAST(i - 1 AS INTEGER) AS s_idx, ss[i] AS sentence, CAST(len(ss[i]) AS INTEGER) AS chars FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s)""")
def _(spark, d):
    return P.sentences(par(spark, d), LATIN)


@query("zh_split_sentences", f"""WITH {ZPAR}, s AS (SELECT doc_id, p_idx, {S.sentence_list("text", ZH)} AS ss FROM par)
SELECT doc_id, p_idx, CAST(i - 1 AS INTEGER) AS s_idx, ss[i] AS sentence, CAST(len(ss[i]) AS INTEGER) AS chars FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s)""")
def _(spark, d):
    return P.sentences(P.paragraphs(zh_docs(spark, d), ZH), ZH)


@query("boundary_sentences", f"""WITH {PAR}, e AS (SELECT doc_id, p_idx, text, list_filter(list_transform(string_split_regex(text, {S.q(LATIN.edge)}), lambda x: {S.strip("x")}), lambda x: x <> '') AS e FROM par)
SELECT doc_id, p_idx, CASE WHEN len(e) > 0 THEN e[1] ELSE left(text, 50) END AS first_sentence, CASE WHEN len(e) > 0 THEN e[-1] ELSE right(text, 50) END AS last_sentence FROM e""")
def _(spark, d):
    return P.boundary_sentences(par(spark, d), LATIN)


@query("tokenize_counts", f"""WITH {PAR}, t AS (SELECT doc_id, p_idx, {S.tokens("text", LATIN)} AS t FROM par)
SELECT doc_id, p_idx, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_types FROM t""")
def _(spark, d):
    t = par(spark, d).select("doc_id", "p_idx", P.tokens(F.col("text"), LATIN).alias("t"))
    return t.select("doc_id", "p_idx", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_types"))


@query("zh_segments", f"WITH {ZPAR} SELECT doc_id, p_idx, array_to_string({S.tokens('text', ZH)}, ' ') AS words FROM par")
def _(spark, d):
    return P.paragraphs(zh_docs(spark, d), ZH).select("doc_id", "p_idx", F.array_join(P.tokens(F.col("text"), ZH), " ").alias("words"))


@query("zh_tokenize_counts", f"""WITH {ZPAR}, t AS (SELECT doc_id, p_idx, {S.tokens("text", ZH)} AS t FROM par)
SELECT doc_id, p_idx, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_types FROM t""")
def _(spark, d):
    t = P.paragraphs(zh_docs(spark, d), ZH).select("doc_id", "p_idx", P.tokens(F.col("text"), ZH).alias("t"))
    return t.select("doc_id", "p_idx", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_types"))


def _dimension(name: str) -> None:
    key = {"paragraph_similarity": "dim_paragraph_similarity", "hapax_ratio": "dim_hapax", "zipf_deviation": "dim_zipf", "bigram_repetition": "dim_bigram_rep", "trigram_repetition": "dim_trigram_rep", "punctuation_entropy": "dim_punct_entropy", "overall_entropy": "dim_char_entropy"}.get(name, f"dim_{name}")
    similar = name == "paragraph_similarity"
    source = TALK if similar else PAR
    part = f"{S.similarity(LATIN)} SELECT doc_id, p_idx, round(paragraph_similarity, 6) AS paragraph_similarity FROM sim" if similar else f"{S.dims(LATIN, False)} SELECT doc_id, p_idx, round({name}, 6) AS {name} FROM dims"

    @query(key, f"WITH {source}, {part}")
    def _(spark, d):
        if similar:
            return D.similarity(talk(spark, d), LATIN).select("doc_id", "p_idx", *rounded(name))
        return D.dimensions(par(spark, d), LATIN, False).select("doc_id", "p_idx", *rounded(name))


for _name in NAMES:
    _dimension(_name)


@query("dims_wide", f"WITH {PAR}, {S.dims(LATIN)} SELECT doc_id, p_idx, " + ", ".join(f"round({n}, 6) AS {n}" for n in NAMES) + " FROM dims")
def _(spark, d):
    return D.dimensions(par(spark, d), LATIN).select("doc_id", "p_idx", *rounded(*NAMES))


@query("zh_dims_wide", f"WITH {ZPAR}, {S.dims(ZH)} SELECT doc_id, p_idx, " + ", ".join(f"round({n}, 6) AS {n}" for n in NAMES) + " FROM dims")
def _(spark, d):
    return D.dimensions(P.paragraphs(zh_docs(spark, d), ZH), ZH).select("doc_id", "p_idx", *rounded(*NAMES))


@query("dims_long", f"WITH {PAR}, {S.dims(LATIN)}, {S.unpivoted()} SELECT doc_id, p_idx, dim, dim_ord, value, zone, gap, description, weight FROM lng")
def _(spark, d):
    return D.unpivoted(D.dimensions(par(spark, d), LATIN))


@query("paragraph_levels", f"WITH {PAR}, {S.dims(LATIN)}, {S.classified()} SELECT doc_id, p_idx, ai_count, gray_count, human_count, round(comprehensive_score, 6) AS comprehensive_score, level FROM cls")
def _(spark, d):
    return D.classified(D.dimensions(par(spark, d), LATIN)).select("doc_id", "p_idx", "ai_count", "gray_count", "human_count", *rounded("comprehensive_score"), "level")


@query("ranked_gaps", f"""WITH {PAR}, {S.dims(LATIN)}, {S.unpivoted()} SELECT doc_id, p_idx, dim, gap, CAST(row_number() OVER (PARTITION BY doc_id, p_idx ORDER BY gap DESC, dim_ord) AS INTEGER) AS rank FROM lng WHERE zone = 'ai'""")
def _(spark, d):
    return D.ranked_gaps(D.unpivoted(D.dimensions(par(spark, d), LATIN))).select("doc_id", "p_idx", "dim", "gap", "rank")


@query("level_overview", f"WITH {PAR}, {S.dims(LATIN)}, {S.classified()} SELECT level, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM cls GROUP BY level")
def _(spark, d):
    from pyspark.sql import Window

    n = D.classified(D.dimensions(par(spark, d), LATIN)).groupBy("level").count()
    return n.select("level", F.col("count").alias("n"), F.round(F.col("count") / F.sum("count").over(Window.partitionBy()), 6).alias("share"))


@query("levels_rollup", f"""WITH {PAR}, {S.dims(LATIN)}, {S.classified()} SELECT lang, source, count(*) AS paragraphs, count(*) FILTER (level IN ('red', 'deep_red')) AS high_risk, round(avg(comprehensive_score), 6) AS mean_score
FROM cls JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)""")
def _(spark, d):
    full = spark.read.parquet(f"{d}/documents.parquet")
    rows = D.classified(D.dimensions(P.paragraphs(documents(spark, d), LATIN), LATIN)).join(full.select("doc_id", "lang", "source"), "doc_id")
    high = F.count_if(F.col("level").isin("red", "deep_red"))
    return rows.rollup("lang", "source").agg(F.count(F.lit(1)).alias("paragraphs"), high.alias("high_risk"), F.round(F.avg("comprehensive_score"), 6).alias("mean_score"))


@query("human_markers", f"WITH {ZPAR}, cls AS (SELECT * FROM par), hm AS (SELECT *, {S.HUMAN} AS human_score FROM cls) SELECT doc_id, p_idx, human_score FROM hm")
def _(spark, d):
    return P.paragraphs(zh_docs(spark, d), ZH).select("doc_id", "p_idx", D.human_score(F.col("text")).alias("human_score"))


@query("guarded_levels", f"WITH {ZPAR}, {S.dims(ZH)}, {S.classified()}, {S.GUARD} SELECT doc_id, p_idx, human_score, is_classical, guard_triggered, guard_reason, original_level, level, round(comprehensive_score, 6) AS comprehensive_score FROM grd")
def _(spark, d):
    rows = D.scanned(P.paragraphs(zh_docs(spark, d), ZH), ZH)
    return rows.select("doc_id", "p_idx", "human_score", "is_classical", "guard_triggered", "guard_reason", "original_level", "level", *rounded("comprehensive_score"))

"""Rule and vector evidence together: levels, ranked gaps, instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packs import Pack
from ..functions.text import nearest
from ..functions.thresholds import DESCRIPTIONS, RULE_DIMENSIONS, SEMANTIC_DIMENSIONS, SEMANTIC_KEYS

# What to do about a dimension.
INSTRUCTIONS = {
    "connector_density": "删除/替换3-5个AI高频连接词(如: 因此/然而/此外)",
    "sentence_length_std": "拆分1-2个长句(>35字), 或合并2个相邻短句(<10字), 让句长分布更不均匀",
    "info_density": "在1-2处注入口语化短句或主观评价, 打破信息密度的均匀性",
    "term_density": "将1-2个过于规整的学术术语替换为口语化表达",
    "slop_density": "删除或替换以下AI标志性短语(如: 综上所述/值得注意的是)",
    "paragraph_similarity": "打破相邻段落的语义结构, 在第N段插入一句离题评论或过渡性的自我质疑",
    "hapax_ratio": "增加用词的多样性, 避免重复使用相同的描述词",
    "zipf_deviation": "适当使用低频词或口语化表达, 让词频分布更接近自然语言",
    "bigram_repetition": "避免重复使用相同的短语搭配",
    "trigram_repetition": "打破固定的三词组合模式",
    "punctuation_entropy": "增加标点多样性, 将部分逗号改为分号, 或加入破折号、省略号",
    "overall_entropy": "引入更多样化的表达方式, 打破字词使用的规律性",
    "sem_paragraph_similarity": "让相邻段落的主题有所跳跃, 不要每段都完美承接上段",
    "sem_argument_linearity": "在论证中插入一个迂回或自我质疑的句子, 打破直线的A->B->C逻辑",
    "sem_transition_naturalness": "让段间过渡更自然, 不要每段都用特定连接词开头",
}


def fused_level(level: Column, rule_ai: Column, semantic_ai: Column) -> Column:
    both = rule_ai + semantic_ai
    return F.when(both >= 10, "deep_red").when(both >= 6, "red").when(both >= 3, "yellow").when(level.isin("red", "deep_red"), "red").when(level == "yellow", "yellow").otherwise("green")


def _fused(n: Column) -> list[Column]:
    """The columns of a fused scan, from those of a rule scan and the number of vector dimensions in the ai zone, null without vector evidence."""
    has, every = n.isNotNull(), len(RULE_DIMENSIONS) + len(SEMANTIC_DIMENSIONS)
    both = F.col("ai_count") + F.coalesce(n, F.lit(0))
    return [
        F.col("doc_id"), F.col("p_idx"), F.col("comprehensive_score").alias("rule_score"), F.col("level").alias("rule_level"), F.col("ai_count").alias("rule_ai_count"), F.col("gray_count").alias("rule_gray_count"),
        F.coalesce(n, F.lit(0)).cast("int").alias("semantic_ai_count"), F.when(has, every).otherwise(len(RULE_DIMENSIONS)).alias("total_dimensions"), both.cast("int").alias("combined_ai_count"),
        F.when(has, both / every).otherwise(F.col("comprehensive_score")).alias("combined_score"), F.when(has, fused_level(F.col("level"), F.col("ai_count"), n)).otherwise(F.col("level")).alias("fused_level"),
    ]


def fused(rules: DataFrame, semantic: DataFrame) -> DataFrame:
    """Each paragraph's rule result with the counts of its vector dimensions; without any, the rule result passes as it is.

    rules: doc_id, p_idx, comprehensive_score, level, ai_count, gray_count. Scores are not rounded.
    """
    own = semantic.groupBy("doc_id", "p_idx").agg(F.count_if(F.col("zone") == "ai").alias("s"))
    return rules.join(own, ["doc_id", "p_idx"], "left").select(*_fused(F.col("s")))


_GAP = ("dim", "layer", "description", "value", "gap")


def together(par: DataFrame, pack: Pack, make=None, embedding: bool = True) -> DataFrame:
    """All of fused(), text, and gaps: the dimensions of both layers in the ai zone as an array of (dim, layer, description, value, gap), by gap from the largest; equal ones rule first, in order.

    Texts are read once: rule results ride through the window of the vectors, and nothing is joined with itself. Vector dimensions go by the names that reports have for them. Without `embedding` only the rules count.
    """
    from .dimensions import leveled, listed, scanned
    from .semantic import judged, walked

    columns = ("level", "comprehensive_score", "ai_count", "gray_count", "listed")
    # both layers are counted in one walk, and levels taken before rows move, so that what reports need of a text moves and the text does not
    rows = leveled(walked(par, pack, make, rules=True), pack) if embedding else scanned(par, pack)
    rows = rows.withColumn("listed", listed())
    rows = judged(rows, columns) if embedding else rows.select("doc_id", "p_idx", "text", *columns).withColumn("evidence", F.lit(None).cast("array<struct<dim:string,dim_ord:int,value:double,zone:string,gap:double>>"))
    order = {d: 100 + k for k, d in enumerate(SEMANTIC_KEYS)}
    item = lambda dim, ord_, layer, description, value, gap: F.struct((-nearest(gap, 6)).alias("k"), ord_.alias("o"), F.struct(*(c.alias(n) for c, n in zip((dim, layer, description, value, gap), _GAP, strict=True))).alias("x"))
    ai = lambda c: F.filter(F.coalesce(c, F.array()), lambda x: x.zone == "ai")
    rule = F.transform(ai(F.col("listed")), lambda x: item(x.dim, x.dim_ord, F.lit("rule"), x.description, x.value, x.gap))
    named = lambda pairs, x: _literal_map(pairs)[x.dim]
    vector = F.transform(ai(F.col("evidence")), lambda x: item(named(SEMANTIC_KEYS, x), named(order, x), F.lit("embedding"), named(DESCRIPTIONS, x), x.value, x.gap))
    gaps = F.transform(F.array_sort(F.concat(rule, vector)), lambda x: x.x)
    n = F.when(F.col("evidence").isNotNull(), F.size(ai(F.col("evidence"))))
    return rows.select(*_fused(n), "text", gaps.alias("gaps"))


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs.items() for x in p))


def gap_report(rows: DataFrame) -> DataFrame:
    """doc_id, p_idx, layer, dim, description, value, gap, rank: the gaps of together() as rows, numbered from 1."""
    long = rows.select("doc_id", "p_idx", F.posexplode("gaps").alias("pos", "g"))
    return long.select("doc_id", "p_idx", "g.layer", "g.dim", "g.description", "g.value", "g.gap", (F.col("pos") + 1).alias("rank"))


def number(value: Column) -> Column:
    """A number of up to six places as reports write it: no zeros at the end but one after the point, and below 0.0001 with an exponent."""
    micro = F.round(value * 1e6).cast("long")
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.round(value, 6)), "0+$", ""), "\\.$", ".0")
    tiny = lambda k, unit: F.concat(F.regexp_replace((micro / unit).cast("decimal(3,1)").cast("string"), "\\.0$", ""), F.lit(f"e-0{k}"))
    return F.when((micro > 0) & (micro < 10), tiny(6, 1)).when((micro > 0) & (micro < 100), tiny(5, 10)).otherwise(short)


def instructions(spark: SparkSession, report: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, p_idx, rank, instruction for the largest gaps of each paragraph: by the dimension's name, with or without its prefix, or else a plain one."""
    table = _literal_map(INSTRUCTIONS)
    plain = F.concat(F.lit("减少 "), F.col("description"), F.lit(" 的AI特征 (当前: "), number(F.col("value")), F.lit(", 差距: "), F.format_string("%.2f", nearest(F.col("gap"), 2)), F.lit(")"))
    told = F.coalesce(table[F.col("dim")], table[F.replace(F.col("dim"), F.lit("sem_"), F.lit(""))], plain)
    return report.filter(F.col("rank") <= most).select("doc_id", "p_idx", "rank", told.alias("instruction"))

"""The twelve statistics of a paragraph, their zones, levels and gaps.

The statistics are counted in one pass over each text, batch by batch (see kernels.py): within their row, so no statistic moves a row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packs import Pack
from ..functions.text import nearest
from ..functions.thresholds import DESCRIPTIONS, RULE_DIMENSIONS, gap, zone
from .kernels import MOST_TERMS, Kernel


def similarity(par: DataFrame, pack: Pack, most: int = MOST_TERMS) -> DataFrame:
    """Adds paragraph_similarity: the cosine of the TF-IDF vectors of text and prev, over their most frequent terms (ties by term)."""

    def run(texts: pd.Series, before: pd.Series) -> pd.Series:
        kernel = Kernel(pack)
        return pd.Series([kernel.similarity(kernel.tokens(t), kernel.tokens(p), most) for t, p in zip(texts, before)], dtype=float)

    return par.withColumn("paragraph_similarity", F.pandas_udf(run, "double")("text", "prev"))


def dimensions(par: DataFrame, pack: Pack, compare: bool = True, keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, p_idx, text, further columns to keep and the twelve values, not rounded. Without `compare` the similarity to the paragraph before is 0."""
    names = [d[0] for d in RULE_DIMENSIONS]

    def run(texts: pd.Series, before: pd.Series) -> pd.DataFrame:
        kernel = Kernel(pack)
        return pd.DataFrame([kernel.values(t, p) for t, p in zip(texts, before)], columns=names, dtype=float)

    values = F.pandas_udf(run, ", ".join(f"{n} double" for n in names))("text", F.col("prev") if compare else F.lit(None).cast("string"))
    more = [c.alias(name) for name, c in (keep or {}).items()]
    return par.select("doc_id", "p_idx", "text", *more, values.alias("_v")).select("doc_id", "p_idx", "text", *(keep or {}), "_v.*")


def classified(dims: DataFrame) -> DataFrame:
    """Adds zone_<dimension> for each dimension, the counts of zones, comprehensive_score and level."""
    zoned = dims.withColumns({f"zone_{d[0]}": zone(F.col(d[0]), d) for d in RULE_DIMENSIONS})
    count = lambda z: sum((F.when(F.col(f"zone_{d[0]}") == z, 1).otherwise(0) for d in RULE_DIMENSIONS), F.lit(0))
    weight = sum((F.when(F.col(f"zone_{d[0]}") == "ai", d[3]).otherwise(0.0) for d in RULE_DIMENSIONS), F.lit(0.0))
    out = zoned.withColumns({"ai_count": count("ai"), "gray_count": count("gray"), "human_count": count("human"), "comprehensive_score": weight / sum(d[3] for d in RULE_DIMENSIONS)})
    return out.withColumn("level", level(F.col("ai_count")))


def level(ai_count: Column) -> Column:
    return F.when(ai_count >= 5, "deep_red").when(ai_count >= 3, "red").when(ai_count >= 2, "yellow").otherwise("green")


def listed() -> Column:
    """The dimensions of a row as an array of (dim, dim_ord, value, zone, gap, description, weight); value and gap to four places, the zone by the exact value."""
    each = [
        F.struct(
            F.lit(d[0]).alias("dim"), F.lit(k).alias("dim_ord"), nearest(F.col(d[0]), 4).alias("value"), zone(F.col(d[0]), d).alias("zone"),
            nearest(gap(F.col(d[0]), d), 4).alias("gap"), F.lit(DESCRIPTIONS[d[0]]).alias("description"), F.lit(float(d[3])).alias("weight"),
        )
        for k, d in enumerate(RULE_DIMENSIONS)
    ]
    return F.array(*each)


def unpivoted(dims: DataFrame) -> DataFrame:
    """doc_id, p_idx and what listed() has: a row for each dimension."""
    return dims.select("doc_id", "p_idx", F.explode(listed()).alias("d")).select("doc_id", "p_idx", "d.*")


def ranked_gaps(long: DataFrame, keys: tuple[str, ...] = ("doc_id", "p_idx")) -> DataFrame:
    """The dimensions in the ai zone, numbered by their rounded gap from the largest; equal gaps by the order of dimensions."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc("gap"), "dim_ord")
    return long.filter("zone = 'ai'").withColumn("rank", F.row_number().over(w))


# Points of the signs of a human hand.
HUMAN_SIGNS = [
    ("(?:我|我们|俺|咱)(?:觉得|认为|发现|注意到|猜测|怀疑|担心|希望|看见|看到|听到|闻到|感到|想起|记得|知道|明白)", 1, "第一人称叙事"),
    ("(?:难道|为啥|怎么|何必|岂不|还真是|确实啊|吧|呢|嘛|啦)", 1, "口语反问"),
    ("(?:是那样的).{0,20}(?:是那样的)|(?:不是.{0,15}也不是.{0,15}而是)", 2, "排比句式"),
    ("(?:像.{2,8}(?:一样|似的|般)|如同|仿佛|宛若|恰似|像是.{2,8}在)", 2, "拟人比喻"),
    ("(?:不禁|簌簌|的确|确实|实在|真正|深深|多么|忍不住|不由得|不觉|不知不觉)", 1, "情感强度词"),
    ("我(?:的|的)?(?:泪|心|眼|手|脚|脸|背|头|身子)", 2, "亲身感受"),
]
# Endings of narrative clauses, and marks of classical prose.
NARRATIVE = "(?:着|地|下去|上来|起来|过去|过来|进去|进来|出去|出来)(?:[，。；]|$)"
CLASSICAL = "(?:不是.{0,20}而是|像.{2,8}一样|满眼都是|.{2,4}得.{2,4})"


def _human_signs(text: Column) -> list[tuple[Column, int, str]]:
    """(whether it is there, points, name) of each sign, in the order of reports; commas in short steps and three narrative endings are signs too."""
    commas = F.length(text) - F.length(F.translate(text, "，,", ""))
    brisk = (commas > 0) & (F.length(F.translate(text, " \n", "")) / F.greatest(commas, F.lit(1)) < 20)
    named = [(text.rlike(f"(?d){p}"), n, name) for p, n, name in HUMAN_SIGNS]
    return [*named[:-1], (brisk, 1, "短句节奏"), (F.regexp_count(text, F.lit(NARRATIVE)) >= 3, 2, "散文叙事"), named[-1]]


def human_score(text: Column) -> Column:
    """The points of all signs of a human hand that the text has."""
    return sum((F.when(there, n).otherwise(0) for there, n, _ in _human_signs(text)), F.lit(0))


def human_marks(text: Column) -> Column:
    """The names of those signs, written as a list."""
    return F.concat(F.lit("["), F.array_join(F.array_compact(F.array(*(F.when(there, F.lit(f"'{name}'")) for there, _, name in _human_signs(text)))), ", "), F.lit("]"))


def guarded(rows: DataFrame) -> DataFrame:
    """From text, level and comprehensive_score: human_score, is_classical, guard_triggered, guard_reason, original_level, and level and score lowered by the first rule that holds."""
    out = rows.withColumn("human_score", human_score(F.col("text"))).withColumn("original_level", F.col("level"))
    out = out.withColumn("is_classical", ((F.col("human_score") >= 4) & F.col("text").rlike(f"(?d){CLASSICAL}")) | (F.col("human_score") >= 5))
    lv, hs, cl = F.col("original_level"), F.col("human_score"), F.col("is_classical")
    down = F.when(lv == "deep_red", "red").when(lv == "red", "yellow").when(lv == "yellow", "green").otherwise(lv)
    named = lambda tail: F.concat(F.lit("检测到"), human_marks(F.col("text")), F.lit(tail))
    rules = [
        (cl & (lv != "green"), down, 0.5, F.lit("检测到经典文学特征（排比/拟人/诗化语言），降级处理")),
        ((hs >= 4) & (lv != "green"), down, 0.6, named("等强人类写作特征（≥4分）")),
        ((hs >= 3) & lv.isin("red", "deep_red"), F.lit("yellow"), 0.7, named("等强人类写作特征")),
        ((hs >= 2) & (lv == "deep_red"), F.lit("red"), 0.85, named("等人类写作特征")),
    ]
    new, factor, why, hit = F, F, F, F.lit(False)
    for cond, to, k, reason in rules:
        new, factor, why, hit = new.when(cond, to), factor.when(cond, k), why.when(cond, reason), hit | cond
    return out.withColumns({"level": new.otherwise(lv), "comprehensive_score": F.col("comprehensive_score") * factor.otherwise(1.0), "guard_triggered": hit, "guard_reason": why.otherwise("")})


def scanned(par: DataFrame, pack: Pack, compare: bool = True, keep: dict[str, Column] | None = None) -> DataFrame:
    """Dimensions, zones, score and level of each paragraph, with the guard where the pack has one."""
    return leveled(dimensions(par, pack, compare, keep), pack)


def leveled(dims: DataFrame, pack: Pack) -> DataFrame:
    """Zones, score and level of paragraphs whose statistics are known, with the guard where the pack has one."""
    rows = classified(dims)
    return guarded(rows) if pack.guard else rows

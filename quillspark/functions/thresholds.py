"""Zones of the measured dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name, ai range, human ranges, weight; a range includes its bounds.
RULE_DIMENSIONS = [
    ("sentence_length_std", (5, 8), [(12, 20)], 1.2),
    ("connector_density", (8, 15), [(2, 6)], 1.1),
    ("info_density", (0.65, 0.75), [(0.40, 0.55), (0.75, 0.80)], 0.9),
    ("term_density", (6, 100), [(0, 4)], 0.8),
    ("paragraph_similarity", (0.7, 0.9), [(0.2, 0.5)], 1.0),
    ("hapax_ratio", (0.25, 0.35), [(0.45, 0.65)], 0.7),
    ("zipf_deviation", (0.15, 0.50), [(0.0, 0.10)], 0.6),
    ("bigram_repetition", (0.08, 0.30), [(0.0, 0.04)], 0.8),
    ("trigram_repetition", (0.03, 0.20), [(0.0, 0.01)], 0.6),
    ("punctuation_entropy", (0.0, 1.5), [(2.0, 3.5)], 0.5),
    ("overall_entropy", (3.0, 5.0), [(6.0, 8.0)], 0.5),
    ("slop_density", (3, 20), [(0, 1)], 1.3),
]
SEMANTIC_DIMENSIONS = [
    ("paragraph_semantic_similarity", (0.70, 0.95), [(0.20, 0.50)], 1.0),
    ("argument_linearity", (0.00001, 0.0002), [(0.0005, 0.005)], 0.8),
    ("semantic_backtrack_rate", (0.0, 0.05), [(0.10, 0.30)], 0.5),
    ("transition_naturalness", (0.65, 0.95), [(0.15, 0.45)], 0.6),
]

# What the dimensions are called in reports.
DESCRIPTIONS = {
    "sentence_length_std": "句长方差",
    "connector_density": "连接词密度",
    "info_density": "信息密度",
    "term_density": "术语密度",
    "paragraph_similarity": "段落结构相似度",
    "hapax_ratio": "Hapax Legomena比率",
    "zipf_deviation": "Zipf偏离度",
    "bigram_repetition": "Bigram重复率",
    "trigram_repetition": "Trigram重复率",
    "punctuation_entropy": "标点熵",
    "overall_entropy": "整体字符熵",
    "slop_density": "Slop词密度",
    "paragraph_semantic_similarity": "段落语义相似度",
    "argument_linearity": "论证线性度（全局）",
    "semantic_backtrack_rate": "语义回溯率（全局）",
    "transition_naturalness": "跨段衔接自然度",
}
# The names of vector dimensions in reports, in the order that settles equal gaps.
SEMANTIC_KEYS = {
    "paragraph_semantic_similarity": "paragraph_similarity",
    "transition_naturalness": "transition_naturalness",
    "argument_linearity": "argument_linearity",
    "semantic_backtrack_rate": "semantic_backtrack",
}


def zone(value: Column, dimension: tuple) -> Column:
    """ai first, then human; whatever is in neither is gray."""
    _, ai, human, _ = dimension
    within = lambda r: (value >= F.lit(float(r[0]))) & (value <= F.lit(float(r[1])))
    out = F.when(within(ai), "ai")
    for r in human:
        out = out.when(within(r), "human")
    return out.otherwise("gray")


def gap(value: Column, dimension: tuple) -> Column:
    """The distance to the human range; 0 within it, and where there are two."""
    _, _, human, _ = dimension
    if len(human) > 1:
        return F.lit(0.0)
    low, high = map(float, human[0])
    return F.greatest(F.lit(low) - value, value - F.lit(high), F.lit(0.0))


def zone_sql(value: str, dimension: tuple) -> str:
    _, ai, human, _ = dimension
    cases = "".join(f" WHEN {value} BETWEEN {float(r[0])!r}::DOUBLE AND {float(r[1])!r}::DOUBLE THEN 'human'" for r in human)
    return f"CASE WHEN {value} BETWEEN {float(ai[0])!r}::DOUBLE AND {float(ai[1])!r}::DOUBLE THEN 'ai'{cases} ELSE 'gray' END"


def gap_sql(value: str, dimension: tuple) -> str:
    _, _, human, _ = dimension
    if len(human) > 1:
        return "0.0::DOUBLE"
    return f"greatest({float(human[0][0])!r}::DOUBLE - {value}, {value} - {float(human[0][1])!r}::DOUBLE, 0.0::DOUBLE)"

"""Signals of sentences, their zones, the spread of zones to neighbours, and the roll-up to documents."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packs import Pack
from ..functions.text import deviation, fixed, hits, nearest, run_lengths, run_starts, strip
from ..functions.thresholds import RULE_DIMENSIONS
from .dimensions import leveled
from .kernels import Kernel
from .parse import sentence_array


def java(pattern: str) -> str:
    """Dots match all but line feeds, as the patterns mean them."""
    return f"(?d){pattern}"


def sentence_stats(sent: DataFrame, pack: Pack) -> DataFrame:
    """Adds lexical_diversity, char_entropy, word_repetition and unique_char_ratio; 1, 0, 0 and 1 under five characters."""

    def run(sentences: pd.Series) -> pd.DataFrame:
        kernel = Kernel(pack)
        return pd.DataFrame([kernel.sentence_values(s) for s in sentences], columns=["lexical_diversity", "char_entropy", "word_repetition", "unique_char_ratio"])

    values = F.pandas_udf(run, "lexical_diversity double, char_entropy double, word_repetition int, unique_char_ratio double")("sentence")
    return sent.select("*", values.alias("_v")).select(*sent.columns, "_v.*")


def template_score(text: Column, pack: Pack) -> Column:
    """The weights of all templates of which at least 0.6 of the parts occur, in steps of hundredths."""
    score = F.lit(0)
    for parts, weight in pack.templates:
        own = sum((text.rlike(java(p)).cast("int") for p in parts), F.lit(0))
        score = score + F.when(own >= len(parts) * 0.6, round(weight * 100)).otherwise(0)
    return score / 100.0


def starter(sentence: Column, pack: Pack) -> Column:
    """What the first pattern that fits has captured; null where none does."""
    own = [F.when(sentence.rlike(java(p)), F.regexp_extract(sentence, java(p), 1)) for p in pack.starters]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def by_formula(values: list) -> Column:
    """The value of the formula that a row of sentence_rows() has; null without one."""
    out = F
    for k, v in enumerate(values):
        out = out.when(F.col("_formula") == k, F.lit(v))
    return out.otherwise(None) if values else F.lit(None)


def formula(sentence: Column, pack: Pack) -> Column:
    """The weight of the first formula that the sentence has."""
    out = F
    for p, w, _ in pack.formulas:
        out = out.when(sentence.rlike(java(p)), w)
    return out.otherwise(0.0) if pack.formulas else F.lit(0.0)


def paragraph_signals(par: DataFrame, pack: Pack, *keep: str) -> DataFrame:
    """doc_id, p_idx, text, sents, the columns to keep, and what all sentences of a paragraph share: template, parallel and even."""
    base = par.select("doc_id", "p_idx", "text", *keep, sentence_array(F.col("text"), pack).alias("sents"))
    keys = F.sort_array(F.filter(F.transform("sents", lambda s: starter(s, pack)), lambda k: k.isNotNull()))
    a = base.select("*", keys.alias("_k"), F.filter(F.transform("sents", lambda s: F.length(s).cast("double")), lambda n: n >= 10).alias("_l"))
    # columns of their own, or they are computed again for each use
    b = a.select("*", run_starts(F.col("_k")).alias("_ks"), F.when(F.size("_l") >= 3, deviation(F.col("_l"))).alias("_sd"))
    spread = F.col("_sd")
    return b.select(
        "doc_id", "p_idx", "text", "sents", *keep,
        template_score(F.col("text"), pack).alias("template"),
        F.when((F.size("sents") >= 3) & F.exists(run_lengths(F.col("_ks"), F.size("_k")), lambda n: n >= 3), 0.20).otherwise(0.0).alias("parallel"),
        F.when(F.size("_l") < 3, 0.0).when(spread < 5, 0.10).when(spread < 8, 0.06).otherwise(0.0).alias("even"), spread.alias("spread"),
    )


#: Of each sentence, and of each paragraph, what counted() finds: names and types.
SENTENCE = {
    "sentence": "string", "lexical_diversity": "double", "char_entropy": "double", "word_repetition": "int", "unique_char_ratio": "double",
    "_high": "int", "_medium": "int", "_low": "int", "_slop": "int", "_starts": "boolean", "_formula": "int",
}
PARAGRAPH = {d[0]: "double" for d in RULE_DIMENSIONS} | {"self_ppl": "double", "new_word_ratio": "double", "template": "double", "parallel": "double", "even": "double", "spread": "double"}
_ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}


def counted(text: Column, pack: Pack) -> Column:
    """Everything that a scan of sentences counts in a paragraph, in one pass over its text: the twelve statistics without comparison, how well it foretells itself, what its sentences share, and `sents`, an array of what each
    sentence has."""
    schema = ", ".join(f"{n} {t}" for n, t in PARAGRAPH.items()) + ", sents array<struct<" + ", ".join(f"{n}: {t}" for n, t in SENTENCE.items()) + ">>"
    columns = lambda rows, kinds: [pa.array(c, _ARROW[t]) for c, t in zip(zip(*rows) if rows else ((),) * len(kinds), kinds.values(), strict=True)]

    def run(texts: pa.Array) -> pa.Array:
        kernel = Kernel(pack)
        rows, sents, starts = [], [], [0]
        for t in texts.to_pylist():
            t = t or ""
            tokens, own = kernel.tokens(t), kernel.sentences(t)
            shared, each = kernel.marks(t, own)
            rows.append((*kernel.values(t, None, tokens, own), *kernel.foretold(t, tokens), *shared))
            sents += [(x, *kernel.sentence_values(x), *more) for x, more in zip(own, each)]
            starts.append(len(sents))
        held = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(columns(sents, SENTENCE), list(SENTENCE)))
        return pa.StructArray.from_arrays([*columns(rows, PARAGRAPH), held], [*PARAGRAPH, "sents"])

    return F.arrow_udf(run, schema)(text)


def reference_latch(par: DataFrame, pack: Pack) -> DataFrame:
    """Adds in_references: true from the first paragraph of a document that begins a list of references."""
    w = Window.partitionBy("doc_id").orderBy("p_idx").rowsBetween(Window.unboundedPreceding, 0)
    return par.withColumn("in_references", F.max(strip(F.col("text")).rlike(pack.references)).over(w))


def self_perplexity(par: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, p_idx, self_ppl, new_word_ratio: how well the first half of the tokens foretells the second; -1 under 20 tokens. Not rounded."""

    return par.select("doc_id", "p_idx", foretold(F.col("text"), pack).alias("_v")).select("doc_id", "p_idx", "_v.*")


def foretold(text: Column, pack: Pack) -> Column:
    """self_ppl and new_word_ratio of a text."""

    def run(texts: pd.Series) -> pd.DataFrame:
        kernel = Kernel(pack)
        return pd.DataFrame([kernel.foretold(t) for t in texts], columns=["self_ppl", "new_word_ratio"], dtype=float)

    return F.pandas_udf(run, "self_ppl double, new_word_ratio double")(text)


def self_signal(ppl: Column, new: Column) -> Column:
    """By the perplexity to two places and the share to three."""
    ppl, new = nearest(ppl, 2), nearest(new, 3)
    low = F.when(ppl < 6, 0.10).when(ppl < 12, 0.05).otherwise(0.0)
    few = F.when(new < 0.25, 0.05).when(new < 0.40, 0.02).otherwise(0.0)
    return F.when(ppl < 0, -1.0).otherwise(low + few)


def bigram_signal(p: Column) -> Column:
    return F.when(p < 0, -1.0).when(p > 0.25, 0.10).when(p > 0.12, 0.06).when(p > 0.05, 0.02).otherwise(0.0)


def human_signal(sim: Column) -> Column:
    """The nearer to known human texts, the smaller."""
    return F.when(sim < 0, -1.0).when(sim > 0.65, 0.0).when(sim > 0.50, 0.04).when(sim > 0.35, 0.10).otherwise(0.16)


def uniform_signal(sim: Column) -> Column:
    return F.when(sim > 0.82, 0.14).when(sim > 0.72, 0.08).otherwise(0.0)


def char_signal(sim: Column) -> Column:
    return F.when(sim > 0.5, 0.40).when(sim > 0.3, 0.22).otherwise(0.0)


def connector_signal(sentence: Column, pack: Pack) -> Column:
    """The first tier that hits decides."""
    return tier_signal(*(hits(sentence, pack.connectors[k]) for k in ("high", "medium", "low")))


def tier_signal(high: Column, medium: Column, low: Column) -> Column:
    return F.when(high >= 2, 0.30).when(high == 1, 0.18).when(medium >= 2, 0.22).when(medium == 1, 0.10).when(low >= 2, 0.08).when(low == 1, 0.04).otherwise(0.0)


def stats_signal() -> Column:
    """From the columns of sentence_stats, for sentences of at least 15 characters."""
    parts = (
        F.when(F.col("lexical_diversity") < 0.55, 0.10).when(F.col("lexical_diversity") < 0.68, 0.05).otherwise(0.0)
        + F.when(F.col("char_entropy") < 3.0, 0.07).when(F.col("char_entropy") < 3.8, 0.03).otherwise(0.0)
        + F.when(F.col("word_repetition") >= 3, 0.10).when(F.col("word_repetition") >= 2, 0.05).otherwise(0.0)
        + F.when(F.col("unique_char_ratio") < 0.50, 0.07).when(F.col("unique_char_ratio") < 0.62, 0.03).otherwise(0.0)
    )
    return F.when(F.col("chars") >= 15, parts).otherwise(0.0)


def _reasons(pack: Pack, given: set[str], learnt: bool) -> Column:
    """Why a sentence scores, in words, in the order in which signals are added; what holds for the whole paragraph is said of its first sentence. learnt: a model has given a probability."""
    first, long = F.col("s_idx") == 0, F.col("chars") >= 15
    percent = lambda c: F.concat(F.bround(100 * c).cast("int").cast("string"), F.lit("%"))
    high, medium = F.col("_high"), F.col("_medium")
    value = lambda name: F.col(name) if name in given else F.lit(0.0)
    unlikely = [F.when(F.col("bigram") > 0, F.concat(F.lit("bigram(prob="), fixed(value("avg_prob"), 2), F.lit(")"))), F.when(F.col("own") > 0, F.concat(F.lit("自洽(self_ppl="), fixed(value("self_ppl"), 1), F.lit(")")))]
    said = [
        F.when(long & (F.col("lexical_diversity") < 0.55), F.concat(F.lit("词汇重复("), percent(F.col("lexical_diversity")), F.lit(")"))),
        F.when(long & (F.col("char_entropy") < 3.0), F.concat(F.lit("字熵低("), fixed(F.col("char_entropy"), 1), F.lit(")"))),
        F.when(long & (F.col("word_repetition") >= 3), F.concat(F.lit("词重复x"), F.col("word_repetition").cast("string"))),
        F.when(long & (F.col("unique_char_ratio") < 0.50), F.concat(F.lit("字面单调("), percent(F.col("unique_char_ratio")), F.lit(")"))),
        F.when(first & (F.col("uniform") > 0), F.concat(F.lit("段内同质化("), percent(value("intra_sim")), F.lit(")"))),
        F.when(F.col("_like") > 0.3, F.concat(F.lit("char指纹"), percent(F.col("_like")))),
        F.when(high >= 1, F.concat(F.lit("高连接词x"), high.cast("string"))).when(medium >= 2, F.concat(F.lit("中连接词x"), medium.cast("string"))),
        F.when(F.col("_slop") >= 1, F.lit("Slop模式")),
        F.when((F.col("parallel") > 0) & F.col("_starts"), F.lit("排比句式")),
        by_formula([name for _, _, name in pack.formulas]).cast("string"),
        F.when(first & (F.col("even") > 0) & (F.col("chars") >= 10), F.concat(F.lit("句长均匀(std="), fixed(F.col("spread"), 1), F.lit(")"))),
        F.when(first & (F.col("bigram") + F.col("own") > 0), F.concat(F.lit("低困惑度:"), F.concat_ws(",", *unlikely))),
        F.when(first & (F.col("human") > 0), F.concat(F.lit("不像人类(sim="), fixed(value("human_sim"), 2), F.lit(")"))),
        F.when(first, F.concat(F.lit("ML("), percent(F.col("probability")), F.lit(")")) if learnt else F.lit("段首句")),
    ]
    return F.array_compact(F.array(*said))


def sentence_rows(par: DataFrame, pack: Pack, extra: DataFrame | None = None, char_sim: DataFrame | None = None, latch: bool = True) -> DataFrame:
    """Each sentence of five characters and more with what its signals and features come from; the parameters are those of zones_raw().

    Without `latch`, in_references is false for all, and each paragraph has a row of its own before its sentences, with s_idx -1, no sentence, and `starts`: whether it begins a list of references; a column `last` stays.
    """
    given = set(extra.columns) if extra is not None else set()
    more = [] if latch else ["last"]
    names = [n for n in PARAGRAPH if n not in ("self_ppl", "new_word_ratio")]
    if latch:
        par, more = reference_latch(par, pack), ["in_references"]  # before the counting, so that rows move as texts alone, or not at all where documents are dealt already
    one = par.select("doc_id", "p_idx", "text", *more, counted(F.col("text"), pack).alias("_c")).select("doc_id", "p_idx", "text", *more, *(F.col(f"_c.{n}") for n in names), F.struct("_c.self_ppl", "_c.new_word_ratio").alias("_told"), "_c.sents")
    shared = leveled(one, pack).select("doc_id", "p_idx", "text", "sents", "level", "_told", "template", "parallel", "even", "spread", *more)
    shared = shared if latch else shared.withColumns({"in_references": F.lit(False), "starts": strip(F.col("text")).rlike(pack.references)})
    if extra is not None:
        shared = shared.join(extra, ["doc_id", "p_idx"], "left")
    if "own" not in given:
        shared = shared.withColumns({"own": self_signal(F.col("_told.self_ppl"), F.col("_told.new_word_ratio")), "self_ppl": F.col("_told.self_ppl")})
    for k in ("bigram", "own", "human", "uniform"):
        shared = shared.withColumn(k, F.coalesce(F.col(k), F.lit(0.0)) if k in shared.columns else F.lit(0.0))
    told_by = [k for k in ("avg_prob", "self_ppl", "human_sim", "intra_sim") if k in shared.columns]
    columns = ["doc_id", "p_idx", "template", "parallel", "even", "spread", "level", "in_references", "bigram", "own", "human", "uniform", *told_by, *([] if latch else ["starts", "last"])]
    # the outer form: of the other one the engine makes a filter on the array, for which it counts all texts a second time; rows without a sentence go below
    each = F.posexplode_outer(F.col("sents") if latch else F.concat(F.array(F.lit(None).cast(shared.schema["sents"].dataType.elementType)), "sents")).alias("s_idx", "_s")
    rows = shared.select(*columns, F.size("sents").alias("n_sents"), each).select(*columns, "n_sents", "s_idx", *(F.col(f"_s.{n}") for n in SENTENCE))
    if not latch:
        rows = rows.withColumn("s_idx", F.col("s_idx") - 1)
    rows = rows.withColumn("chars", F.length("sentence")).filter("chars >= 5" if latch else "chars >= 5 OR s_idx < 0")
    if char_sim is not None:
        return rows.join(char_sim.select("doc_id", "p_idx", "s_idx", F.col("similarity").alias("_like")), ["doc_id", "p_idx", "s_idx"], "left")
    return rows.withColumn("_like", F.lit(None).cast("double"))


def zones_raw(par: DataFrame, pack: Pack, extra: DataFrame | None = None, char_sim: DataFrame | None = None, model=None, latch: bool = True) -> DataFrame:
    """doc_id, p_idx, s_idx, sentence, chars, score, zone, signals, reasons, ai_dim_count: each sentence by itself; score not rounded.

    The paragraph's level is that of a paragraph with none before it. Sentences under five characters go; in a list of references all are green
    at 0. How well a paragraph foretells itself always counts. `extra` may bring further signals of paragraphs (doc_id, p_idx, bigram, own, human, uniform), which default to none; those of bigram
    and own count where their sum is above 0; what they come from (avg_prob, self_ppl, human_sim, intra_sim) is named in reasons. `char_sim` (doc_id, p_idx, s_idx, similarity) brings the likeness of sentences to known texts.

    `model` (a scoring.Detector) decides instead: a sentence's score is then the probability that it gives, and its zone the model's. Signals are those that the rules see.

    Without `latch` no row looks beyond its paragraph, so that streams can be scanned: see sentence_rows() for what it adds.
    """
    rows = sentence_rows(par, pack, extra, char_sim, latch)
    told_by = {k for k in ("avg_prob", "self_ppl", "human_sim", "intra_sim") if k in rows.columns}
    told = F.col("bigram") + F.col("own")
    signals = {
        "stats": stats_signal(),
        "uniform": F.col("uniform"),
        "likeness": char_signal(F.coalesce("_like", F.lit(0.0))),
        "connector": tier_signal(F.col("_high"), F.col("_medium"), F.col("_low")),
        "slop": F.when(F.col("_slop") >= 1, 0.28).otherwise(0.0),
        "template": F.col("template") * 0.4,
        "parallel": F.when((F.col("parallel") > 0) & F.col("_starts"), F.col("parallel")).otherwise(0.0),
        "formula": F.coalesce(by_formula([w for _, w, _ in pack.formulas]).cast("double"), F.lit(0.0)),
        "even": F.when(F.col("chars") >= 10, F.col("even")).otherwise(0.0),
        "perplexity": F.when(told > 0, told).otherwise(0.0),
        "human": F.greatest("human", F.lit(0.0)),
        "length": F.when(F.col("chars").between(15, 25), 0.03).otherwise(0.0),
        "first": F.when(F.col("s_idx") == 0, 0.04).otherwise(0.0),
        "last": F.when((F.col("s_idx") == F.col("n_sents") - 1) & (F.col("n_sents") > 1), 0.03).otherwise(0.0),
        "level": F.when(F.col("level").isin("red", "deep_red"), 0.18).when(F.col("level") == "yellow", 0.10).otherwise(0.0),
    }
    protected = F.col("in_references")
    fired = F.array(*(F.when(v > 0, F.lit(k)) for k, v in signals.items()))
    rows = rows.withColumn("signals", F.when(protected, F.array(F.lit("references"))).otherwise(F.array_compact(fired)))
    if model is None:
        total = F.lit(0.0)
        for v in signals.values():
            total = total + v
        rows = rows.withColumn("score", total + 0.03)
        # sums of hundredths: the cut-offs must not hang on the last bit
        cut = F.round("score", 6)
        zone = F.when(cut >= 0.26, "red").when(cut >= 0.20, "orange").when(cut >= 0.10, "yellow").otherwise("green")
    else:
        rows = model.scanned(rows, pack).withColumn("score", F.col("probability"))
        zone = F.col("zone")
    reasons = F.when(protected, F.array(F.lit("参考文献(保护)"))).otherwise(_reasons(pack, told_by, model is not None))
    rows = rows.withColumns({"zone": F.when(protected, "green").otherwise(zone), "score": F.when(protected, 0.0).otherwise(F.least("score", F.lit(1.0))), "reasons": reasons})
    rows = rows.withColumn("ai_dim_count", F.when(protected, 0).otherwise(F.size("reasons")))
    return rows.select("doc_id", "p_idx", "s_idx", "sentence", "chars", "score", "zone", "signals", "reasons", "ai_dim_count", *([] if latch else ["starts", "last"]))


def spread_step(before: str | None, zone: str, score: float, after: str | None) -> tuple[str, float]:
    """Zone and score of a sentence by the zone of the one before it, as it has become, and that of the next, as it was; none at either end of a document: what propagated() does, one step at a time."""
    if before is None or after is None:
        return zone, score
    near = {before, after}
    if zone == "green":
        for colour, to, least in (("red", "orange", 0.22), ("orange", "yellow", 0.10), ("yellow", "yellow", 0.08)):
            if colour in near:
                return to, max(score, least)
    elif zone == "yellow" and "red" in near:
        return "orange", max(score, 0.20)
    return zone, score


def propagated(rows: DataFrame) -> DataFrame:
    """The zones and scores after they have spread from sentence to sentence, left to right, as closed windows over the zones before."""
    w = Window.partitionBy("doc_id").orderBy("p_idx", "s_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    z = rows.withColumns({
        "_1": F.lag("zone", 1).over(w), "_2": F.lag("zone", 2).over(w), "_n": F.lead("zone", 1).over(w),
        "_any": F.coalesce(F.max(F.col("zone") != "green").over(before), F.lit(False)),
    })
    inner = F.col("_1").isNotNull() & F.col("_n").isNotNull()
    red = (F.col("_1") == "red") | (F.col("_n") == "red")
    orange = (F.col("_1") == "orange") | (F.col("_1").isin("green", "yellow") & (F.coalesce("_2", F.lit("")) == "red")) | (F.col("_n") == "orange")
    green, yellow = F.col("zone") == "green", F.col("zone") == "yellow"
    touched = F.col("_any") | (F.col("_n") != "green")
    new = F.when(inner & green & red, "orange").when(inner & green & touched, "yellow").when(inner & yellow & red, "orange").otherwise(F.col("zone"))
    floor = F.when(inner & green & red, 0.22).when(inner & green & touched & orange, 0.10).when(inner & green & touched, 0.08).when(inner & yellow & red, 0.20).otherwise(0.0)
    return z.withColumns({"zone": new, "score": F.greatest("score", floor)}).drop("_1", "_2", "_n", "_any")


def document_summary(rows: DataFrame) -> DataFrame:
    """A row per document: characters, share of those in red or orange sentences (not rounded), and counts."""
    of = lambda *z: F.count_if(F.col("zone").isin(*z))
    ai = F.sum(F.when(F.col("zone").isin("red", "orange"), F.col("chars")).otherwise(0))
    return rows.groupBy("doc_id").agg(
        F.sum("chars").alias("total_chars"), ai.cast("double").alias("ai_chars"), (ai / F.sum("chars")).alias("ai_rate"), F.count(F.lit(1)).alias("total_sentences"),
        of("red").alias("ai_sentences"), of("red", "orange", "yellow").alias("suspect_sentences"), of("red").alias("red_count"), of("orange").alias("orange_count"), of("yellow").alias("yellow_count"),
    )


def verdict(rate: Column) -> Column:
    return F.when(rate > 0.40, "high").when(rate > 0.15, "partial").otherwise("safe")


def zone_shares(rows: DataFrame) -> DataFrame:
    """Each zone's count, its share of all sentences and of the suspect ones."""
    n = rows.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("zone") != "green", F.col("n"))).alias("suspect"))
    return n.crossJoin(F.broadcast(total)).select("zone", "n", (F.col("n") / F.col("all")).alias("share"), F.when(F.col("zone") != "green", F.col("n") / F.col("suspect")).alias("share_of_suspect"))

"""Phrases whose words stand together more often than their parts would by chance.

All runs of one to `longest` words become rows and are counted per language by hash aggregation. A run can be as frequent as asked only if both runs of one word less in it
are; so the runs of each length are exploded where those a word shorter have passed, and the rest, which no result could hold or use, never becomes a row. The counts of first
and remaining parts are joined to each phrase, scores are whole decimals, an anti-join takes out what only stands inside a longer phrase, and windows rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._filters import Filter
from ._shared import slices, small_batches, text_bytes, written
from ._words import FIXED, LOWER, Words, _hashed, mix, windows, within

#: Words of a phrase at most, its occurrences at least, and phrases of a language in the result.
LONGEST = 5
LEAST = 100
TOP = 2000
#: Bits of the filter of frequent runs at most: 32 MB in each task. The fuller it is, the more rare runs become rows, which the count then leaves out.
FILTER_BITS = 28
#: Languages whose totals are sent to every task at most.
SENT = 100_000
#: Bytes that end a piece of text, and those between words.
_ENDS, _BETWEEN = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_BETWEEN[list(b" \t")] = True
_BETWEEN |= _ENDS
_SPACE = np.zeros(256, bool)
_SPACE[0x20] = True


def _runs(ids: np.ndarray, begin: np.ndarray, n: int, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of n words: where one begins (an index of `begin`), and how many there are. Told apart by the numbers of their words, so exactly."""
    key, size = lang[begin].astype(np.int64), int(lang.max(initial=0)) + 1
    for k in range(n):
        word = ids[begin + k].astype(np.int64)
        most = int(word.max(initial=0)) + 1
        if size * most >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            size = len(distinct)
        key, size = key * most + word, size * most
    _, first, many = np.unique(key, return_index=True, return_counts=True)
    return first, many


def _names(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.dictionary_encode()
    return np.asarray(found.indices), found.dictionary.cast(pa.large_string())


def _hashes(distinct: pa.Array) -> np.ndarray:
    raw, at = text_bytes(distinct)
    return _hashed(raw, at[:-1], at[1:], FIXED)


def _exploded(docs: DataFrame, n: int, shared) -> DataFrame:
    """lang, phrase, many: the runs of n words in pieces, of which both parts of n - 1 words pass the filter. With n = 1 also the empty phrase, once for each word.

    Equal runs of one stretch of a batch come as one row with their number.
    """

    def run(batches):
        for batch in batches:
            lang_at, langs = _names(batch.column(0))
            lang_hash = _hashes(langs)
            raw, at = text_bytes(batch.column(1))
            for i, j in slices(at):
                text = LOWER[raw[at[i] : at[j]]]
                words = Words(text, at[i : j + 1] - at[i], _BETWEEN, None)
                if not len(words.starts):
                    continue
                offsets = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
                flat = pa.Array.from_buffers(pa.large_string(), len(words.starts), [None, pa.py_buffer(offsets), pa.py_buffer(text[~_BETWEEN[text]])])
                ids, distinct = _names(flat)
                lang = np.repeat(lang_at[i:j], words.counts())
                cuts = np.unique(np.concatenate([np.searchsorted(words.starts, np.flatnonzero(_ENDS[text])), words.at]))
                begin, _ = within(cuts, n)
                if shared is not None:
                    key = windows(_hashes(distinct)[ids], n - 1)
                    passed = shared.value.has(mix(key ^ lang_hash[lang[: len(key)]]))
                    begin = begin[passed[begin] & passed[begin + 1]]
                if len(begin):
                    first, many = _runs(ids, begin, n, lang)
                    at_word = begin[first]
                    parts = [distinct.take(pa.array(ids[at_word + k])) for k in range(n)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[at_word])).cast(pa.string()), phrase.cast(pa.string()), pa.array(many, pa.int64())], ["lang", "phrase", "many"])
                if n == 1:
                    total = np.bincount(lang, minlength=len(langs))
                    has = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(has)).cast(pa.string()), pa.array([""] * len(has)), pa.array(total[has], pa.int64())], ["lang", "phrase", "many"])

    return docs.mapInArrow(run, "lang string, phrase string, many long")


def _keys(frequent: DataFrame, n: int) -> DataFrame:
    """The filter's key of each phrase of n words."""

    def run(batches):
        for batch in batches:
            lang_at, langs = _names(batch.column(0))
            raw, at = text_bytes(batch.column(1))
            words = Words(raw, at, _SPACE)
            key = windows(words.hash, n)[words.at[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(mix(key ^ _hashes(langs)[lang_at]).view(np.int64))], ["key"])

    return frequent.filter("phrase <> ''").select("lang", "phrase").mapInArrow(run, "key long")


def counted(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase, words, f: all phrases of up to `longest` words that occur `least` times in their language, and for each language the empty phrase with the number of all its words."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    levels, shared = [], None
    for n in range(1, longest + 1):
        # the sum comes before the filter, so what passes is exact whatever the filter let through
        found = _exploded(base, n, shared).groupBy("lang", "phrase").agg(F.sum("many").alias("f")).filter(f"f >= {int(least)} OR phrase = ''")
        found = written(found.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(n).alias("words"), "f"), "phrases")
        levels.append(found)
        if n < longest:
            shared = spark.sparkContext.broadcast(Filter(_keys(found, n), FILTER_BITS))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of each phrase of two words or more, by its lowest-scoring cut (the first of equal ones)."""
    number = lambda c: F.col(c).cast("decimal(18,0)")
    totals = frequent.filter("words = 0").select("lang", number("f").alias("n"))
    parts = frequent.filter("words > 0").select("lang", "phrase", number("f").alias("f"))
    longer = frequent.filter("words > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    cuts = longer.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "words", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("rest"),
    )
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    # few languages are sent to their phrases; beyond the bound a join deals the phrases out, and splits the largest
    totals = F.broadcast(totals) if totals.limit(SENT + 1).count() <= SENT else totals
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(1000BD * CAST(a AS DECIMAL(18,0)) * n) div (l * r)")
    best = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", *(F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("best.l", "best.r", "n", "best.score")))


def standing_alone(phrases: DataFrame) -> DataFrame:
    """The phrases without those that only occur inside a longer one. One with a word more is enough to look at: if a phrase always stands in one of several words more, it
    always stands in each between them too, and that is as frequent."""
    w = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(w, 1, F.col("words") - 1), " "), F.array_join(F.slice(w, 2, F.col("words") - 1), " ")))
    longer = phrases.filter("words > 2").select("lang", inner.alias("phrase"), "a")
    return phrases.join(longer, ["lang", "phrase", "a"], "left_anti")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language. The order is taken in ever larger shares of it, so that no task gets a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    shares = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while shares > 1:
        by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
        shares = int(shares**0.5)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language, by score, then a, both falling, then phrase in byte order.

    Texts are split into pieces at .,;:!? and line ends, pieces into words at spaces and tabs; A-Z count as lower case. a: occurrences of the
    phrase; l, r: of the first part and the rest at the lowest-scoring cut; n: words of the language; score: floor(1000 * a * n / (l * r)). A null language is `und`, a null text empty;
    repeated rows count as often as they stand. Tables without frequent phrases give no rows. Other columns are not read, so their names are free.
    """
    frequent = counted(docs, longest, least, lang_col, text_col)
    phrases = written(scored(frequent), "scored")
    return _ranked(standing_alone(phrases), top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {
    "op12_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
runs AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) t(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM runs GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.w, n.n, s.j, l.f AS l, r.f AS r, (1000 * c.a * n.n) // (l.f * r.f) AS score
  FROM c JOIN n USING (lang) JOIN range(1, {LONGEST}) s(j) ON s.j < c.k
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, s.j), ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, s.j + 1, c.k), ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, a
  FROM c, range(2, {LONGEST}) t(m), range(1, {LONGEST}) u(i) WHERE m < k AND i + m - 1 <= k),
kept AS (SELECT best.* FROM best ANTI JOIN inside ON best.lang = inside.lang AND best.phrase = inside.phrase AND best.a <= inside.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= {TOP}
"""
}

"""Language of texts by the nearest of several centroids.

A text becomes a vector of hashed character n-grams of its letters, weighted by TF-IDF
and brought to length 1. Each language has several centroids, found by spherical clustering of
sample texts; that of the highest cosine names the language. A text further from it than nearly all
sample texts that belong there is rejected.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import slices, small_batches, text_bytes

#: Hashed n-grams, as a power of two.
BITS = 12
SIZES = (1, 2, 3)
#: Sample texts of a language, and of all languages, at most about.
PER_LANGUAGE = 600
IN_ALL = 6000
CENTROIDS = 4
#: The share of a centroid's own sample texts that lie beyond its radius.
BEYOND = 0.005
#: Characters in one numpy pass.
STEP = 1 << 20
UNKNOWN = "und"

_MULTIPLY = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _classes() -> np.ndarray:
    """For each character up to U+FFFF: itself in lower case if it is a letter, else a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for k in range(1 << 16):
        c = chr(k)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


_table: list[np.ndarray] = []


def letters(raw: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 text, lower-cased, with a space for whatever is no letter."""
    if not _table:
        _table.append(_classes())
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) and points.max() >= 1 << 16:
        far = points >= 1 << 16
        out = _table[0][np.where(far, 32, points)]
        out[far] = [ord(chr(p)) if chr(p).isalpha() else 32 for p in points[far].tolist()]
        return out
    return _table[0][points]


def grams(points: np.ndarray) -> np.ndarray:
    """How often each hashed n-gram occurs; runs of spaces count as one, and no n-gram reaches over one."""
    total = np.zeros(1 << BITS)
    keep = 2
    for i in range(0, max(len(points), 1), STEP):
        p = points[max(0, i - keep) : i + STEP].astype(np.uint32)
        new = min(i, keep)
        if i == 0:
            p = np.concatenate([[np.uint32(32)], p])
        if i + STEP >= len(points):
            p = np.concatenate([p, [np.uint32(32)]])
        space = p == 32
        for n in SIZES:
            if len(p) < n:
                continue
            h = np.zeros(len(p) - n + 1, np.uint32)
            for j in range(n):
                h = (h ^ p[j : j + len(h)]) * _MULTIPLY[j]
                h ^= h >> np.uint32(15)
            # a space may begin or end an n-gram, but not alone
            fine = ~(space[:-1] & space[1:]) if n == 2 else ~space[n // 2 : n // 2 + len(h)]
            # what ends in the part read before is counted there
            ends = np.arange(n - 1, n - 1 + len(h))
            if i:
                fine &= ends >= new
            total += np.bincount(h[fine] >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total


class Model:
    """languages; centroids [n, 2^BITS] of length 1; owner: the language of each; radius: the least cosine of what belongs there."""

    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, radius: np.ndarray):
        self.languages, self.idf, self.centroids, self.owner, self.radius = languages, idf, centroids.astype(np.float32), owner, radius

    def predict(self, counts: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Of count vectors, one a row: language number, cosine and whether it is rejected; -1 for those without n-grams."""
        x = weigh(counts, self.idf).astype(np.float32)
        cos = x @ self.centroids.T if len(self.owner) else np.zeros((len(x), 0))
        if not len(self.owner):
            return [-1] * len(x), np.zeros(len(x)), np.ones(len(x), bool)
        best = cos.argmax(1)
        score = np.clip(cos[np.arange(len(x)), best], 0, 1).astype(float)
        empty = ~counts.any(1)
        return np.where(empty, -1, self.owner[best]).tolist(), np.where(empty, 0, score), empty | (score < self.radius[best])


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def cluster(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means: at most k centroids of unit vectors, the first at random and each next far from those before."""
    rng = np.random.default_rng(seed)
    centers = [x[rng.integers(len(x))]]
    while len(centers) < min(k, len(x)):
        far = 1 - (x @ np.array(centers).T).max(1)
        if far.max() < 1e-6:
            break
        centers.append(x[rng.choice(len(x), p=np.maximum(far, 0) ** 2 / (np.maximum(far, 0) ** 2).sum())])
    c = np.array(centers)
    for _ in range(25):
        near = (x @ c.T).argmax(1)
        new = np.array([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


def _vectors(batches, text: int):
    """(batch, row, counts) of each text."""
    for batch in batches:
        raw, at = text_bytes(batch.column(text))
        for k in range(len(at) - 1):
            yield batch, k, grams(letters(raw[at[k] : at[k + 1]]))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 0, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model:
    """Learn from a sample of the rows with a language whose crc32 of the id as text, modulo 5, is not `held_out`.

    The sample is the `per_language` distinct texts of smallest hash in each language, fewer where there are more than
    in_all / per_language languages. It is the only part of the data that learning reads; the centroids depend on nothing else. Both bounds are
    parameters. Of more than in_all languages, those with the most rows are learnt.
    """
    rest = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5))
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (rest != held_out))
    named = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    sizes = [r.lang for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(in_all).collect()]
    if not sizes:
        return Model([], np.ones(1 << BITS), np.zeros((0, 1 << BITS)), np.zeros(0, int), np.zeros(0))
    each = max(1, min(per_language, in_all // len(sizes)))
    # equal texts are one before they are drawn, so that copies and repeated ids neither fill the sample nor keep a language out of it
    ranked = named.select("lang", "h").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("rank") <= each)
    last = {r.lang: r.h for r in ranked.groupBy("lang").agg(F.max("h").alias("h")).collect() if r.lang in set(sizes)}
    upto = F.create_map(*(F.lit(x) for pair in last.items() for x in pair))
    drawn = named.filter(F.col("h") <= upto[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def run(batches):
        for batch, k, counts in _vectors(batches, 1):
            where = np.flatnonzero(counts)
            if len(where):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([where.astype(np.int16).tobytes()]), pa.array([counts[where].astype(np.float32).tobytes()])], ["lang", "at", "n"])

    rows = sorted((r.lang, bytes(r.at), bytes(r.n)) for r in drawn.mapInArrow(run, "lang string, at binary, n binary").collect())
    counts = np.zeros((len(rows), 1 << BITS), np.float32)
    for k, (_, at, n) in enumerate(rows):
        counts[k, np.frombuffer(at, np.int16)] = np.frombuffer(n, np.float32)
    languages = sorted({r[0] for r in rows})
    number = np.array([languages.index(r[0]) for r in rows], int)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))) + 1
    x = weigh(counts, idf)
    centers, owner, radius = [], [], []
    for k in range(len(languages)):
        own = x[number == k]
        c = cluster(own, CENTROIDS)
        near = (own @ c.T).argmax(1)
        for j in range(len(c)):
            cos = own[near == j] @ c[j]
            centers.append(c[j])
            owner.append(k)
            radius.append(float(np.quantile(cos, BEYOND)) if len(cos) else 1.0)
    return Model(languages, idf, np.array(centers).reshape(-1, 1 << BITS), np.array(owner, int), np.array(radius))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 0, model: Model | None = None) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, rejected.

    lang_pred is the language of the nearest centroid and score its cosine; `und` and 0 for a text that is null or has no letter, and
    for all where nothing could be learnt. rejected: the text is further from that centroid than its own sample texts
    are, so it may be of none of the languages. Ties go to the first language by name. A null id is neither held
    out nor different otherwise. Rows that repeat an id get a row each. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    if model is None:
        model = fit(docs, id_col, text_col, lang_col, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            for i, j in slices(at):
                for a in range(i, j, 256):
                    b = min(j, a + 256)
                    counts = np.stack([grams(letters(raw[at[k] : at[k + 1]])) for k in range(a, b)])
                    found, score, rejected = m.predict(counts)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a), pa.array([m.languages[x] if x >= 0 else UNKNOWN for x in found]), pa.array(score), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"]
                    )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rest = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5))
    out = slim.mapInArrow(run, "id long, lang_pred string, score double, rejected boolean")
    return out.select(F.col("id").alias(id_col), F.coalesce(rest == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict = {}

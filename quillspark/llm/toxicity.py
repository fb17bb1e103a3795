"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

Both are interpolated bigram models on counts of texts: how many distinct texts of a class have a pair of words. A pair backs off to its
word, by the number of contexts the word has in the class (continuation counts), and a word to one shared distribution:
how many texts of either class have it. The discount of a count is not fixed: the less the evidence that the two classes differ in a
word (or in a pair, beyond its word), the more of its count goes to the shared back-off. So rare expressions get the same
probability from both classes, and what one class has markedly more often speaks for it. The evidence is the posterior probability
that the word's share of toxic texts is one of its own, where a priori one word in all kinds is like that.

The mean over a text's words of the difference of log-likelihoods is put to a probability by a logistic curve, fitted on rows that the
models it scores have not seen.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._joined import JoinedModel, joined_models
from ._shared import small_batches, slices, text_bytes, unwrite, written
from ._words import LOWER, NOT_ALNUM, Words, windows

#: Labelled rows on which the curve is fitted, about, half of them of each class.
CURVE_ROWS = 6000
#: Labels sent to every executor; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Words, and pairs, with evidence that go to every worker at most; a larger model is met by joins.
MOST_ENTRIES = 5_000_000
#: What a count loses at least.
DISCOUNT = 0.75
#: A word or pair of which the evidence is below this counts as one without any.
NEGLIGIBLE = 1e-3
THRESHOLD = 0.7
COUNT_BYTES = 2 << 20
#: Rows of counts in an Arrow batch.
OUT_ROWS = 1 << 17
#: The folds that a model learns from.
MODELS = ((0,), (1,), (0, 1))
#: The context of a text's first word.
BEGIN = np.uint64(0x5EED5EED5EED5EED)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers of 1 and more."""
    low = np.where(x < 8, np.log(np.prod([np.where(x < 8, x + k, 1.0) for k in range(8)], 0)), 0.0)
    y = np.where(x < 8, x + 8, x)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - low


def evidence(counts: np.ndarray, share: np.ndarray | float, kinds: float) -> np.ndarray:
    """The posterior probability that a word's share of toxic is its own and not `share`, by counts [2, words] of both classes.

    A share of its own is anywhere between 0 and 1, and a priori one word of all kinds has it.
    """
    k0, k1 = counts
    for_own = _log_gamma(k1 + 1) + _log_gamma(k0 + 1) - _log_gamma(k0 + k1 + 2)
    odds = for_own - k1 * np.log(share) - k0 * np.log1p(-share) - np.log(max(kinds, 1.0))
    return np.where(k0 + k1 > 0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))), 0.0)


def find(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each among ascending hashes, -1 for those that are not there."""
    if not len(hashes):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[at] == wanted, at, -1)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return windows(np.stack([first, second], 1).reshape(-1), 2)[::2]


class Model:
    """Arrays for the two classes; ratio() scores texts.

    Words and pairs without evidence need no entry: of those all that is needed is in the sums. hashes: words with evidence, ascending, with
    that, their contexts [2, words] in each class and their shared probability; in_class: contexts [2] of all words. pairs: hashes of pairs with evidence, ascending, with their
    first and second words, evidence, counts [2, pairs], totals [2, pairs] of their first words and the shared probability of their second.
    """

    def __init__(self, hashes, weight, contexts, shared, in_class, pairs, first, pair_weight, pair_counts, totals, pair_shared):
        self.hashes, self.word, self.rest_word = hashes, np.empty((2, len(hashes))), np.empty(2)
        rest = max(1.0 - float((weight * shared).sum()), 1e-9)
        for c in (0, 1):
            off, every = np.minimum(contexts[c], DISCOUNT), float(in_class[c]) + DISCOUNT
            untold = (float(in_class[c]) - float((weight * contexts[c]).sum())) / every
            given = (float((weight * off).sum()) + DISCOUNT) / every
            self.word[c] = weight * (contexts[c] - off) / every + untold * (1 - weight) * shared / rest + given * shared
            self.rest_word[c] = untold / rest + given  # of a word without evidence, times its shared probability
        self.pairs, self.pair, self.pair_shared = pairs, pair_weight * np.maximum(pair_counts - DISCOUNT, 0) / np.maximum(totals, 1), pair_shared
        self.contexts, at = np.unique(first, return_inverse=True)
        self.left = np.stack([1 - np.bincount(at, x, len(self.contexts)) for x in self.pair]) if len(pairs) else np.ones((2, 0))

    def ratio(self, words: Words) -> np.ndarray:
        """The mean log-likelihood of toxic over ordinary per word of each text; that of a word without evidence for a text without words."""
        h = words.hash
        base = float(np.log(self.rest_word[1]) - np.log(self.rest_word[0]))
        out, at = np.full(len(h), base), find(self.hashes, h)
        told = at >= 0
        out[told] = np.log(self.word[1, at[told]]) - np.log(self.word[0, at[told]])
        if len(self.pairs) and len(h):
            before = np.empty(len(h), np.uint64)
            before[0], before[1:] = BEGIN, h[:-1]
            before[words.at[:-1][words.at[:-1] < len(h)]] = BEGIN
            context = find(self.contexts, before)
            use = np.flatnonzero(context >= 0)
            pair, w, v = find(self.pairs, pair_hash(before[use], h[use])), at[use], context[use]
            known, own = pair >= 0, w >= 0
            # the shared probability of a word without evidence cancels where its pair has none either
            p = [np.where(known, self.pair_shared[pair], 1.0) * self.rest_word[c] for c in (0, 1)]
            for c in (0, 1):
                p[c][own] = self.word[c, w[own]]
                p[c] = self.left[c, v] * p[c] + np.where(known, self.pair[c, pair], 0)
            out[use] = np.log(p[1]) - np.log(p[0])
        sums = np.concatenate([[0], np.cumsum(out)])
        n = words.counts()
        return np.where(n > 0, (sums[words.at[1:]] - sums[words.at[:-1]]) / np.maximum(n, 1), base)


def _passes(batches, column: int, most: int):
    """(rows from, to, words) of each stretch of a batch."""
    for batch in batches:
        raw, at = text_bytes(batch.column(column))
        for i, j in slices(at, most):
            yield batch, i, j, Words(LOWER[raw[at[i] : at[j]]], at[i : j + 1] - at[i], NOT_ALNUM)


def _distinct(owner: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where each key of an owner is for the first time."""
    order = np.lexsort((*keys, owner))
    new = np.ones(len(order), bool)
    new[1:] = reduce(or_, ((x[order][1:] != x[order][:-1]) for x in (owner, *keys)))
    return order[new]


def _texts_with(rows: DataFrame, pairs: bool) -> DataFrame:
    """How many texts of each fold and class have each word (word, n0 to n3, and t0 to t3: pairs that begin with it, once a text), or each pair (first, second, n0 to n3)."""

    def run(batches):
        for batch, i, j, words in _passes(batches, 2, COUNT_BYTES):
            fold, label = (np.asarray(batch.column(k).slice(i, j - i)) for k in (0, 1))
            h, of = words.hash, np.repeat(np.arange(j - i), words.counts())
            g = (fold * 2 + label)[of]
            if not len(h):
                continue
            before = np.concatenate([[BEGIN], h[:-1]])
            before[words.at[:-1][words.at[:-1] < len(h)]] = BEGIN
            two = _distinct(of, before, h)
            one = _distinct(of, h)
            for k in range(4):
                here = two[g[two] == k]
                if pairs:
                    x = here[np.lexsort((h[here], before[here]))]
                    a, b = before[x], h[x]
                    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(x) else np.zeros(0, bool))
                    columns = [a[new].view(np.int64), b[new].view(np.int64), np.diff(np.append(new, len(x)))]
                else:
                    first, t = np.unique(before[here], return_counts=True)
                    word, n = np.unique(h[one[g[one] == k]], return_counts=True)
                    every = np.union1d(first, word)
                    columns = [every.view(np.int64), np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)]
                    columns[1][np.searchsorted(every, word)] = n
                    columns[2][np.searchsorted(every, first)] = t
                for at in range(0, len(columns[0]), OUT_ROWS):
                    part = [pa.array(x[at : at + OUT_ROWS], pa.int64()) for x in columns]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(np.full(len(part[0]), k, np.int32))], names)

    names = ["first", "second", "n", "g"] if pairs else ["word", "n", "t", "g"]
    found = rows.mapInArrow(run, ", ".join(f"{x} {'int' if x == 'g' else 'long'}" for x in names))
    per = [F.sum(F.when(F.col("g") == k, F.col(x)).otherwise(0)).alias(f"{x}{k}") for x in names if x in ("n", "t") for k in range(4)]
    return found.groupBy(*[x for x in names if x in ("first", "second", "word")]).agg(*per)


def _table(found: pa.Table) -> np.ndarray:
    """[columns, rows] of whole numbers."""
    return np.stack([np.asarray(c, dtype=np.int64) for c in found.columns]) if found.num_rows else np.zeros((found.num_columns, 0), np.int64)


def _added(n: np.ndarray, folds: tuple[int, ...]) -> np.ndarray:
    """Counts [2, rows] of the classes, from those of folds and classes."""
    return np.stack([sum(n[2 * f + c] for f in folds) for c in (0, 1)]).astype(float)


def _share(totals: np.ndarray) -> float:
    return float(np.clip(totals[1] / max(totals.sum(), 1.0), 1e-9, 1 - 1e-9))


class Scorer:
    """A model and its curve; without both classes among the labelled rows every score is 0."""

    def __init__(self, model: Model | None, slope: float = 0.0, level: float = 0.0):
        self.model, self.slope, self.level = model, slope, level

    def scores(self, words: Words) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(words.at) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.model.ratio(words) + self.level, -500, 500)))


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope, at least 0, and level of a logistic curve, with targets drawn in a little from 0 and 1. weight: how many rows each stands for."""
    pos = float(y.sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    many = np.ones(len(x)) if weight is None else weight / weight.mean()
    mid, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - mid) / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -50, 50)))
        step = np.linalg.solve((z * (many * p * (1 - p))) @ z.T + 1e-4 * np.eye(2), z @ (many * (p - target)) + 1e-4 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(w[0], 0.0) / scale
    return slope, float(w[1]) - slope * mid


class _Told:
    """Words with evidence in any of the models: their hashes, counts and, for each model, evidence and the share to expect of pairs that end with them."""

    def __init__(self, words: np.ndarray, totals: np.ndarray, kinds: dict):
        self.hashes, self.counts, self.kinds = words[0].view(np.uint64), words[1:5], kinds
        self.share, self.weight, self.expected = {}, {}, {}
        for m in MODELS:
            n = _added(self.counts, m)
            share = self.share[m] = _share(totals[list(m)].sum(0))
            w = self.weight[m] = _weight(n, share, kinds[m])
            self.expected[m] = np.clip(w * n[1] / np.maximum(n.sum(0), 1) + (1 - w) * share, 1e-3 * share, 1 - 1e-3 * (1 - share))

    def pairs(self, second: np.ndarray, counts: np.ndarray, m: tuple[int, ...], kinds: float) -> np.ndarray:
        """Evidence of pairs, by where their second words are among the told (-1: not there)."""
        expected = np.full(len(second), self.share[m])
        expected[second >= 0] = self.expected[m][second[second >= 0]]
        return _weight(counts, expected, kinds)


def _weight(counts: np.ndarray, share, kinds: float) -> np.ndarray:
    w = evidence(counts, share, kinds)
    return np.where(w > NEGLIGIBLE, w, 0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 1, most: int = MOST_ENTRIES) -> Scorer:
    """Learn from the labelled rows of which crc32 of the id as text, modulo 3, is not `held_out`.

    Counts cover all of them; equal texts with equal labels count once, as the one of the smallest id. Labels other than 0 and 1 are left out.
    A model of more than `most` words or pairs with evidence stays a table, which is met by joins; the scores are the same.
    """
    spark = docs.sparkSession
    rest = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3))
    fold = F.when(rest == (held_out + 1) % 3, 0).otherwise(1).cast("int")
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (rest != held_out))
    chosen = chosen.select(F.col(id_col).alias("id"), fold.alias("fold"), F.col(label_col).cast("int").alias("label"))
    small = chosen.count() <= BROADCAST_LABELS
    sent = F.broadcast if small else lambda x: x
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    joined = texts.join(sent(chosen), "id")
    # copies of a text would make all its words tell; few rows are copies, so these are what is sent
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    known = written(joined.select("id", "label", sha), "texts")
    first = known.groupBy("sha", "label").agg(F.min("id").alias("first"))
    key = F.xxhash64("sha", "label").alias("key")  # so that the join has exchanges of its own, and a large group's can be split
    again = written(known.select("*", key).join(first.select("*", key), ["key", "sha", "label"]).filter("id > first").select("id", "label", "sha").distinct(), "copies", known.count())
    sent_copies = F.broadcast if again.count() <= BROADCAST_LABELS else lambda x: x
    rows = joined.withColumn("sha", sha).join(sent_copies(again), ["id", "label", "sha"], "left_anti").select("fold", "label", "text")

    words = written(_texts_with(rows, False), "words")
    sums = [f"coalesce(sum(n{g}), 0)" for g in range(4)] + [f"count_if({' + '.join(f'n{2 * f + c}' for f in m for c in (0, 1))} > 0)" for m in MODELS]
    t = np.array(words.agg(*(F.expr(e).alias(str(k)) for k, e in enumerate(sums))).first(), float)
    totals, size = t[:4].reshape(2, 2), dict(zip(MODELS, t[4:]))
    if not totals.sum(0).all():
        return Scorer(None)
    shares = {m: _share(totals[list(m)].sum(0)) for m in MODELS}

    def telling(batches):
        for batch in batches:
            n = _table(pa.Table.from_batches([batch.select(range(1, 5))]))
            yield batch.filter(pa.array(np.any([_weight(_added(n, m), shares[m], size[m]) > 0 for m in MODELS], 0)))

    with_evidence = written(words.mapInArrow(telling, words.schema), "told")
    if with_evidence.count() > most:
        model = joined_models(written(_texts_with(rows, True), "pairs"), words, with_evidence, totals, size)
        return _with_curve(joined, model, totals)
    told = _table(with_evidence.toArrow())
    told = told[:, np.argsort(told[0].view(np.uint64))]
    tells = _Told(told, totals, size)
    shared = spark.sparkContext.broadcast(tells)

    def pairs_and_contexts(batches):
        """Pairs with evidence (as if there were no more kinds of pairs than of words); then, of what was read, contexts of the told words and of all (second is null), of the classes and of either, for each model."""
        tells = shared.value
        found, whole = np.zeros((9, len(tells.hashes)), np.int64), np.zeros(9, np.int64)
        for batch in batches:
            x = _table(pa.Table.from_batches([batch]))
            second = find(tells.hashes, x[1].view(np.uint64))
            keep = np.zeros(x.shape[1], bool)
            for k, m in enumerate(MODELS):
                n = _added(x[2:], m)
                keep |= tells.pairs(second, n, m, size[m]) > 0
                for j, has in enumerate((n[0] > 0, n[1] > 0, n.sum(0) > 0)):
                    whole[3 * k + j] += has.sum()
                    found[3 * k + j] += np.bincount(second[has & (second >= 0)], minlength=found.shape[1])
            own = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.nulls(own.num_rows, pa.list_(pa.int64()))], out)
        rows = [(h, found[:, k].tolist()) for k, h in enumerate(tells.hashes.view(np.int64).tolist()) if found[:, k].any()] + [(None, whole.tolist())]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), *(pa.nulls(len(rows), pa.int64()) for _ in range(4)), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], out)

    out = ["first", "second", "n0", "n1", "n2", "n3", "contexts"]
    got = written(_texts_with(rows, True).mapInArrow(pairs_and_contexts, "first long, second long, n0 long, n1 long, n2 long, n3 long, contexts array<long>"), "pairs")
    added = got.filter("contexts IS NOT NULL").groupBy("second").agg(*(F.sum(F.col("contexts")[k]).alias(f"c{k}") for k in range(9))).collect()
    contexts, whole = np.zeros((9, told.shape[1])), np.zeros(9)
    for r in added:
        if r.second is None:
            whole[:] = r[1:]
        else:
            contexts[:, find(tells.hashes, np.array([r.second]).view(np.uint64))[0]] = r[1:]
    if got.filter("first IS NOT NULL").count() > most:
        model = joined_models(written(_texts_with(rows, True), "pairs"), words, with_evidence, totals, size)
        return _with_curve(joined, model, totals)
    kept = _table(got.filter("first IS NOT NULL").drop("contexts").toArrow())
    first, second = kept[0].view(np.uint64), kept[1].view(np.uint64)
    hashes = pair_hash(first, second)
    order = np.argsort(hashes)
    kept, first, second, hashes = kept[:, order], first[order], second[order], hashes[order]
    # of the words in these pairs: how many texts have them, and how many pairs begin with them
    asked = np.unique(np.concatenate([first, second, tells.hashes]))
    wanted = spark.sparkContext.broadcast(asked)
    among = lambda x: find(wanted.value, np.asarray(x).view(np.uint64)) >= 0
    stand = _table(words.mapInArrow(lambda batches: (b.filter(pa.array(among(b.column(0)))) for b in batches), words.schema).toArrow())
    unwrite(words, got, known, again, with_evidence)
    number = np.zeros((8, len(asked)))
    number[:, find(asked, stand[0].view(np.uint64))] = stand[1:]
    place, last = find(asked, first), find(asked, second)

    def model(m: tuple[int, ...]) -> Model:
        k = 3 * MODELS.index(m)
        n = _added(kept[2:], m)
        weight = tells.pairs(find(tells.hashes, second), n, m, max(whole[k + 2], size[m]))
        use = weight > 0
        shared = (_added(number[:4], m).sum(0) + 1) / (totals[list(m)].sum() + size[m] + 1)
        return Model(tells.hashes, tells.weight[m], contexts[k : k + 2], shared[find(asked, tells.hashes)], whole[k : k + 2], hashes[use], first[use], weight[use], n[:, use], _added(number[4:], m)[:, place[use]], shared[last[use]])

    return _with_curve(joined, model, totals)


def _ratios(df: DataFrame, model, *keep: str) -> DataFrame:
    """The columns to keep, and x: the ratio of each text."""
    if isinstance(model, JoinedModel):
        rows = df.select(*keep, "text", F.xxhash64("text").alias("tk"))
        return rows.join(model.ratios(df.select("text")), "tk").select(*keep, F.col("ratio").alias("x"))
    one = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, i, j, w in _passes(batches, len(keep), COUNT_BYTES):
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keep))), pa.array(one.value.ratio(w))], [*keep, "x"])

    rows = df.select(*keep, "text")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("x", DoubleType())]))


def _with_curve(joined: DataFrame, model, totals: np.ndarray) -> Scorer:
    """The model of all folds, with a curve: models of one fold score a part of the other, drawn from each class by itself. joined: id, fold, label, text."""
    there = {(r.fold, r.label): r["count"] for r in joined.groupBy("fold", "label").count().collect()}
    parts = 1 << 40

    def sample(own: tuple[int, ...], others: tuple[int, ...]) -> tuple[list, list, list]:
        """Ratios by the model of some folds, labels and weights of rows of others."""
        x, y, weight = [], [], []
        shares = {(f, c): min(1.0, CURVE_ROWS / 4 / n) for (f, c), n in there.items() if f in others}
        here = F.pmod(F.xxhash64("id"), F.lit(parts))
        drawn = [(F.col("fold") == f) & (F.col("label") == c) & (here < int(share * parts)) for (f, c), share in shares.items()]
        if drawn:
            for r in _ratios(joined.filter(reduce(or_, drawn)), model(own), "fold", "label").collect():
                x.append(r.x)
                y.append(r.label)
                weight.append(1 / shares[r.fold, r.label])
        return x, y, weight

    found = [sample((own,), (other,)) for own, other in ((0, 1), (1, 0)) if totals[own].all()]
    x, y, weight = (sum(part, []) for part in zip(*found)) if found else ([], [], [])
    if not 0 < sum(y) < len(y):
        # one fold alone has all rows of a class: no model has unseen rows of both
        x, y, weight = sample((0, 1), (0, 1))
    return Scorer(model((0, 1)), *curve(np.array(x), np.array(y), np.array(weight)))


def scored(docs: DataFrame, scorer: Scorer, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows as they are, with a column for the score; a column of that name gives way. A null text is an empty one."""
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col)
    if isinstance(scorer.model, JoinedModel):
        tk = max(docs.columns, key=len) + "_tk"
        keyed = docs.withColumn(tk, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
        found = scorer.model.ratios(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))).withColumnsRenamed({"tk": tk, "ratio": score_col})
        curved = 1 / (1 + F.exp(-F.greatest(F.least(scorer.slope * F.col(score_col) + scorer.level, F.lit(500.0)), F.lit(-500.0))))
        return keyed.join(found, tk).select(*docs.columns, curved.alias(score_col))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch, i, j, words in _passes(batches, place, 2 << 20):
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(words))], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 1, threshold: float = THRESHOLD, most: int = MOST_ENTRIES) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Learns as fit() does and scores every text, labelled or not. Null and empty texts have the score of a text that speaks for neither
    class. A null id is never held out or learnt from. Rows that repeat an id get a row each. Where the labelled rows lack a class,
    scores are 0. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = scored(slim, fit(docs, labels, id_col, text_col, label_col, held_out, most), "text")
    rest = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3))
    return out.select(F.col("id").alias(id_col), F.coalesce(rest == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict = {}

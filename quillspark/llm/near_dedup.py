"""Near-duplicate documents by MinHash bands, sequential Bayesian verification and full sets.

Documents with equal shingle sets form a class, and one of them stands for it. Signatures of the
classes are cut into bands; classes that agree in a band are in one bucket. Candidate pairs
of a bucket are verified in turn: batch after batch of their signatures is compared, and a pair is dropped
as soon as the posterior probability that its similarity reaches the threshold is below the chosen
miss probability. What survives is confirmed or refuted on the full sets.

Words are told apart by hashes at a place drawn for each run (see _words): two given different words of up to 50 bytes agree with chance 2^-58 at most,
so no texts can be made that are taken for each other. Full sets are hashed at a second place, so that no error of the search can repeat in them.

Only buckets of a few classes give all their pairs. In others, first every class is paired with the head of its bucket, in several rounds with
heads drawn anew, each time only in buckets that are not yet of one component. Then what is still apart is compared in full, in
blocks of bounded size: each class outside a bucket's largest component with those of other components there.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._filters import Filter
from ._shared import slices, small_batches, text_bytes, unwrite, written
from ._words import FIXED, LOWER, WHITE, Words, draw, mix, windows, windows_at, within

#: Words in a shingle.
SHINGLE = 5
#: Similarity of a link, in hundredths.
PERCENT = 75
BANDS, ROWS = 32, 4
#: Hashes compared in one step.
BATCH = 16
#: A pair is dropped when the chance that it is a link is below this.
MISS = 1e-6
#: Classes in a bucket of which all pairs are verified.
FEW = 6
#: Rounds of pairing with heads at most; after the first, only while a full comparison would take more than so many pairs.
ROUNDS, MUCH = 5, 100_000_000
#: Classes of a bucket that share a head, and those in a block of a full comparison.
UNDER_HEAD, BLOCK = 5000, 512
#: Pairs that are confirmed with one copy of a set, about.
PAIRS = 1000
#: Bits of the filter of candidate ids at most; with more ids than fit, a join takes its place.
FILTER_BITS = 32

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, ascending in each, and where each text's begin."""
    first, owner = within(words.at, k)
    hashes = windows(words.hash, k)[first]
    n = words.counts()
    short = np.flatnonzero((n > 0) & (n < k))
    for m in range(1, k):
        own = short[n[short] == m]
        hashes = np.concatenate([hashes, windows_at(words.hash, words.at[own], m)])
        owner = np.concatenate([owner, own])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(n) + 1))


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[texts with shingles, BANDS * ROWS] minima."""
    begin = at[:-1][np.diff(at) > 0]
    x = (mix(hashes) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), len(_A)), np.uint32)
    for k in range(len(_A)):
        out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], begin)
    return out


@lru_cache
def least_matches(threshold: float = PERCENT / 100, miss: float = MISS, n: int = BANDS * ROWS, batch: int = BATCH) -> tuple[int, ...]:
    """After each batch, the matches below which P(similarity >= threshold | matches) < miss, with an even prior.

    That posterior is a beta distribution with whole parameters: its upper tail is a binomial sum.
    """
    out = []
    for k in range(batch, n + 1, batch):
        m = 0
        while m <= k and sum(math.comb(k + 1, j) * threshold**j * (1 - threshold) ** (k + 1 - j) for j in range(m + 1)) < miss:
            m += 1
        out.append(m)
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of signatures, a row each, stay through all batches."""
    live, matches = np.arange(len(a)), np.zeros(len(a), int)
    for step, least in enumerate(least_matches()):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches[live] += (a[live, part] == b[live, part]).sum(1)
        live = live[matches[live] >= least]
        if not len(live):
            break
    return live


def _texts(batches, *places: int):
    """Ids, and for each place the shingles and where each text's begin."""
    for batch in batches:
        raw, at = text_bytes(batch.column(1))
        for i, j in slices(at):
            sets = [shingles(Words(LOWER[raw[at[i] : at[j]]], at[i : j + 1] - at[i], WHITE, place)) for place in places]
            yield batch.column(0).slice(i, j - i), *sets


def _signed(base: DataFrame, place: int = FIXED) -> DataFrame:
    """id, n, k1, k2, sig: the size of each set, 128 bits that tell it from others, and its signature."""

    def run(batches):
        for ids, (hashes, at) in _texts(batches, place):
            n = np.diff(at)
            has = n > 0
            k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            sig = [None] * len(n)
            if has.any():
                begin = at[:-1][has]
                k1[has] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), begin)
                k2[has] = np.bitwise_xor.reduceat(mix(hashes ^ np.uint64(0x14057B7EF767814F)), begin)
                for k, s in zip(np.flatnonzero(has).tolist(), signatures(hashes, at)):
                    sig[k] = s.tobytes()
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(sig, pa.binary())], ["id", "n", "k1", "k2", "sig"])

    return base.mapInArrow(run, "id long, n long, k1 long, k2 long, sig binary")


def bands(sig: np.ndarray) -> np.ndarray:
    """[texts, BANDS] keys of signatures, a row each."""
    sig = sig.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
    return key


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two ascending sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < PERCENT * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = int((y[at] == x).sum())
    return 100 * same >= PERCENT * (len(x) + len(y) - same)


def _banded(reps: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            key = bands(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["bucket", "id"])

    return reps.select("id", "sig").mapInArrow(run, "bucket long, id long")


def _split(df: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """A join whose exchanges serve nothing else, so that those of frequent keys can be split."""
    keyed = F.xxhash64(key).alias("xkey")
    return df.select("*", keyed).join(small.select("*", keyed), ["xkey", key]).drop("xkey")


def _sets(base: DataFrame, candidates: DataFrame, places: tuple[int, int], bits: int = FILTER_BITS) -> DataFrame:
    """id, sig, low, set of the candidates, and of a few more ids that the filter lets pass: signature and upper halves of the shingle hashes at the first place, and full hashes at the second."""
    keys = candidates.select(F.xxhash64("id").alias("key"))
    rows = base.select("id", "text", F.xxhash64("id").alias("h"))
    if Filter.fits(keys, bits):
        shared = base.sparkSession.sparkContext.broadcast(Filter(keys, bits))
    else:
        shared, rows = None, _split(rows, candidates, "id").select("id", "text", "h")

    def run(batches):
        for batch in batches:
            if shared is not None:
                batch = batch.take(pa.array(shared.value.passing(np.asarray(batch.column(2)).view(np.uint64))))
            for ids, (hashes, at), (full, full_at) in _texts([batch], *places) if batch.num_rows else []:
                has = np.diff(at) > 0
                if not has.any():
                    continue
                low = [(hashes[a:b] >> np.uint64(32)).astype(np.uint32).tobytes() for a, b in zip(at[:-1], at[1:]) if b > a]
                columns = [[s.tobytes() for s in signatures(hashes, at)], low, [full[a:b].tobytes() for a, b in zip(full_at[:-1], full_at[1:]) if b > a]]
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(has)), *(pa.array(c, pa.binary()) for c in columns)], ["id", "sig", "low", "set"])

    return rows.mapInArrow(run, "id long, sig binary, low binary, set binary")


def _kept(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures leave a chance, and whose sizes allow a link."""
    left = _split(pairs, reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    both = _split(left, reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    both = both.filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for k in (2, 3))
            live = pa.array(plausible(a, b))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(live), batch.column(1).take(live)], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links on their full sets, as (u, v).

    The set of a goes once to each cell of its pairs, that of b with the pair; a cell has about PAIRS pairs, however many a has.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("cells"))
    cell = F.pmod(F.xxhash64("b"), F.col("cells")).cast("int").alias("cell")
    dealt = _split(pairs, many, "a").select("a", cell, F.col("b").alias("id"))
    right = _split(dealt, sets.select("id", "set"), "id").select("a", "cell", F.lit(1).alias("kind"), F.col("id").alias("b"), "set")
    left = _split(many.withColumnRenamed("a", "id"), sets.select("id", "set"), "id")
    left = left.select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("b"), "set")

    def run(batches):
        own = None
        for batch in batches:
            us, vs = [], []
            for a, kind, b, held in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                found = np.frombuffer(held, np.uint64)
                if not kind:
                    own = found
                elif linked(own, found):
                    us.append(a)
                    vs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    both = left.unionByName(right).repartition("a", "cell").sortWithinPartitions("a", "cell", "kind")
    return both.mapInArrow(run, "u long, v long").distinct()


def _labelled(buckets: DataFrame, stars: DataFrame) -> DataFrame:
    """The buckets that are not of one component, with each class's component c."""
    label = stars.select(F.col("u").alias("id"), F.col("v").alias("c"))
    own = buckets.join(label, "id", "left").withColumn("c", F.coalesce("c", "id"))
    mixed = own.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("bucket")
    return _split(own, mixed, "bucket")


def _headed(buckets: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each class with the head of its part of the bucket, but those of one component."""
    draw = F.struct(F.xxhash64("id", F.lit(turn)) if turn else F.lit(0).cast("long"), F.col("id"), F.col("c"))
    part = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("size") / UNDER_HEAD))
    keyed = F.xxhash64("bucket", "part").alias("xkey")
    parted = buckets.withColumn("part", part)
    heads = parted.groupBy("bucket", "part").agg(F.min(draw).alias("h"))
    met = parted.select("*", keyed).join(heads.select("*", keyed), ["xkey", "bucket", "part"]).filter("c <> h.c")
    return met.select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b"))


def _outer(buckets: DataFrame) -> DataFrame:
    """Of each bucket: its largest component, its size, and how many classes are not in that."""
    counts = buckets.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("all"))
    return main.select("bucket", F.col("m.c").alias("main"), (F.col("all") - F.col("m.n")).alias("outer"), "all")


def _apart(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components of a bucket that signatures and halved hashes leave as possible links.

    Classes outside the largest component meet all, block by block. A pair that meets in several buckets is judged in the one
    of the first band on which it agrees: that bucket is not of one component either, or has had all its pairs verified.
    Intersections of halved hashes are never too small, so none that is a link gets lost.
    """
    tagged = _split(buckets.select("bucket", "id", "c"), _outer(buckets), "bucket")
    rows, cols = F.ceil(F.col("outer") / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
    place = lambda n, s: F.pmod(F.xxhash64("id", F.lit(s)), n).cast("int")
    columns = ["bucket", "r", "k", "side", "id", "c"]
    outer = tagged.filter("c <> main").withColumns({"r": place(rows, 1), "k": F.explode(F.sequence(F.lit(0), cols - 1)), "side": F.lit(0)}).select(columns)
    every = tagged.withColumns({"k": place(cols, 2), "r": F.explode(F.sequence(F.lit(0), rows - 1)), "side": F.lit(1)}).select(columns)
    dealt = _split(outer.unionByName(every), sets.select("id", "sig", "low"), "id")

    def compare(table: pa.Table) -> pa.Table:
        side, ids, c = (np.asarray(table.column(x)) for x in ("side", "id", "c"))
        low = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
        n = np.array([len(x) for x in low])
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
        own = bands(sig)
        band = int((own == np.uint64(table.column("bucket")[0].as_py() % (1 << 64))).any(0).argmax())
        ours, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        us, vs = [], []
        for x in ours:
            y = theirs[(c[theirs] != c[x]) & (100 * np.minimum(n[theirs], n[x]) >= PERCENT * np.maximum(n[theirs], n[x]))]
            y = y[~(own[y, :band] == own[x, :band]).any(1)]
            y = y[plausible(np.broadcast_to(sig[x], (len(y), sig.shape[1])), sig[y])]
            for k in y:
                if linked(low[x], low[k]):
                    us.append(min(ids[x], ids[k]))
                    vs.append(max(ids[x], ids[k]))
        return pa.table({"a": pa.array(us, pa.int64()), "b": pa.array(vs, pa.int64())})

    return dealt.groupBy("bucket", "r", "k").applyInArrow(compare, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few_most: int = FEW, rounds: int = ROUNDS, much: int = MUCH, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Words are runs without white space, A-Z in lower case. A document's set has its distinct runs of five words, or all its words as one
    where it has fewer; null and empty texts have an empty set and are linked with nothing. Documents are linked when
    100 * intersection >= 75 * union. component_id is the smallest id that links reach; kept where it is the row's own.
    Rows that repeat an id are one document, and links of any of them are its own. A row without an id is linked with nothing,
    has no component_id and is kept. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    places = draw(), draw()
    signed = written(_signed(base, places[0]), "signed")
    n_docs = signed.count()
    usable = signed.filter("n > 0 AND id IS NOT NULL")
    classes = usable.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"))
    keyed = F.xxhash64("k1", "k2").alias("xkey")
    member = usable.drop("sig").select("*", keyed).join(classes.select("*", keyed), ["xkey", "n", "k1", "k2"]).drop("xkey")
    member = written(member, "classes", n_docs)
    # an id of several classes links them
    twice = member.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("w")).filter("u < w")
    links = written(twice.join(member.select("id", F.col("rep").alias("v")), "id").select("u", "v").filter("u <> v").distinct(), "links", n_docs)
    own = ["id", "n", "k1", "k2"]
    reps = written(usable.join(member.filter("id = rep").select(own).distinct(), own, "left_semi").dropDuplicates(own), "reps", n_docs)
    sizes = written(signed.select("id", "n"), "sizes", n_docs)
    unwrite(signed)

    banded = _banded(reps).distinct()
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = written(_split(banded, shared, "bucket"), "buckets", 4 * n_docs)
    n_pairs = buckets.count()
    few, many = buckets.filter(F.col("size") <= few_most), buckets.filter(F.col("size") > few_most)
    sets = written(_sets(base, buckets.select("id").distinct(), places, filter_bits), "sets")

    def joined(found: DataFrame, stars: DataFrame) -> DataFrame:
        """The components with these links too."""
        out = components(found.unionByName(stars), n_pairs)
        unwrite(stars)
        return out

    pairs = few.select("bucket", F.col("id").alias("a")).join(few.select("bucket", F.col("id").alias("b")), "bucket").filter("a < b").select("a", "b")
    pairs = pairs.unionByName(_headed(many.withColumn("c", F.col("id")), 0))
    stars = joined(_confirmed(written(_kept(pairs.distinct(), reps), "pairs", n_pairs), sets), links)
    for turn in range(1, rounds + 1):
        left = written(_labelled(many, stars), "apart", n_pairs)
        if left.isEmpty():
            break
        last = turn == rounds or _outer(left).agg(F.sum(F.col("outer") * F.col("all")).alias("n")).first().n <= much
        pairs = _apart(left, sets) if last else _kept(_headed(left, turn).distinct(), reps)
        stars = joined(_confirmed(written(pairs.distinct(), "pairs", n_pairs), sets), stars)
        unwrite(left)
        if last:
            break
    unwrite(buckets, sets, reps)
    label = stars.select(F.col("u").alias("rep"), F.col("v").alias("root"))
    found = member.join(label, "rep", "left").select("id", F.coalesce("root", "rep").alias("root")).groupBy("id").agg(F.min("root").alias("root"))
    out = sizes.join(found, "id", "left").select("id", "n", F.coalesce("root", "id").alias("root"))
    out = written(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), (F.col("id").isNull() | (F.col("id") == F.col("root"))).alias("kept")), "near", n_docs)
    unwrite(sizes, member, stars)
    return out


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES = {
    "op4_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(v) AS m FROM r GROUP BY u) c ON c.u = d.doc_id
"""
}

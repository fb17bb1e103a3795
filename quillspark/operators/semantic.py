"""Statistics of paragraph vectors, and their zones.

A vector is an array of numbers of length 1. An encoder makes them, a model's or, without one, lexical_encoder() from the words alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packs import Pack
from ..functions.text import dot, nearest
from ..functions.thresholds import RULE_DIMENSIONS, SEMANTIC_DIMENSIONS, gap, zone
from ..sources.stored import stored
from .kernels import Kernel
from .parse import sentences
from .sentences import human_signal, uniform_signal

#: Characters of a paragraph that is held against known texts, at least.
LEAST_HUMAN = 20
#: Vectors of a pool that go to every task at most.
POOL_BLOCK = 500


def lexical_encoder(pack: Pack):
    """Makes an encoder from the words alone."""

    def make():
        kernel = Kernel(pack)
        return lambda texts: [kernel.vector(t) for t in texts]

    return make


def _encoder(make, strict: bool):
    """A function from texts to vectors that is made once, at its first call. Where it fails, all of them are null, or with `strict` the error goes on."""
    held = []

    def run(texts: list[str]) -> list:
        try:
            if not held:
                held.append(make())
            return [[float(x) for x in v] for v in held[0](texts)]
        except Exception:  # noqa: BLE001  whatever a model raises, the other signals go on without it
            if strict:
                raise
            return [None] * len(texts)

    return run


def encoded(rows: DataFrame, text_col: str, make, vec: str = "vec", strict: bool = True) -> DataFrame:
    """Adds the vector of a text. `make` gives, once a worker's task, a function from a list of texts to as many vectors (a model to load goes there); where it fails, the query fails, or without `strict` vectors are null, which failures() counts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(make, strict)
        for texts in batches:
            yield pd.Series(encode(texts.fillna("").tolist()), index=texts.index, dtype=object)

    return rows.withColumn(vec, F.pandas_udf(run, "array<double>")(text_col))


def failures(rows: DataFrame, text_col: str = "text", vec: str = "vec") -> DataFrame:
    """One row: texts, and how many of them have no vector because the encoder failed."""
    return rows.agg(F.count(text_col).alias("texts"), F.count_if(F.col(text_col).isNotNull() & F.col(vec).isNull()).alias("failed"))


def adjacent_similarity(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """doc_id, p_idx, similarity to the next paragraph; null for the last."""
    w = Window.partitionBy("doc_id").orderBy("p_idx")
    return rows.select("doc_id", "p_idx", dot(F.col(vec), F.lead(vec).over(w)).alias("similarity"))


def linearity(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """doc_id, argument_linearity: the variance of the steps' lengths; 0 under three paragraphs. Not rounded."""
    w = Window.partitionBy("doc_id").orderBy("p_idx")
    step = F.sqrt(F.aggregate(F.zip_with(F.lead(vec).over(w), F.col(vec), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    steps = rows.select("doc_id", step.alias("step"))
    return steps.groupBy("doc_id").agg(F.when(F.count(F.lit(1)) >= 3, F.var_pop("step")).otherwise(0.0).alias("argument_linearity"))


def intra_similarity(rows: DataFrame, vec: str = "vec", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, similarity: the mean of all pairs' products, from sums alone: (|sum v|^2 - sum |v|^2) / (n (n - 1)); -1 under two."""
    parts = rows.select(*keys, F.posexplode(vec).alias("i", "x")).groupBy(*keys, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"), F.count(F.lit(1)).alias("n"))
    n = F.max("n")
    return parts.groupBy(*keys).agg(F.when(n >= 2, (F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (n * (n - 1))).otherwise(-1.0).alias("similarity"))


#: Pivots of a pool's cells at most, vectors that are compared with others at once, and how far rounding may take a bound.
PIVOTS, BLOCK, SLACK = 1024, 512, 1e-9


#: Rows that a task of cells measures at once, and copies of rows that it hands on at once.
SLICE, HANDED = 512, 8192


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [np.asarray(p.flatten(), float) for p in parts]
    return np.concatenate(flat or [np.zeros(0)]).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The largest product of each row of x with any row of y. Of those that rounding could put first, entries are multiplied and added up from the first on, as SQL does it: a matrix product's last bit hangs on the machine and on the rows that came together."""
    dots = x @ y.T
    best = dots.max(1)
    row, ref = np.nonzero(dots >= (best - SLACK * (1 + np.abs(best)))[:, None])
    total, plain = np.zeros(len(row)), np.full(len(x), -np.inf)
    for a, b in zip(x.T, y.T, strict=True):
        total += a[row] * b[ref]
    np.maximum.at(plain, row, total)
    return np.where(plain > -np.inf, plain, best)


def _sliced(batches):
    """Batches of SLICE rows at most: what is measured against every pivot is a table of that many lines."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            yield batch.slice(k, SLICE)


def pool_similarity(rows: DataFrame, pool: DataFrame, keys: list[str], vec: str = "vec", block: int = POOL_BLOCK) -> DataFrame:
    """keys, similarity, compared: the largest product of each row's vector with any vector of the pool (a column ref), of any size, and with how many of the pool it was taken; null for rows without a
    vector and for an empty pool.

    Up to `block` vectors go to every task. A larger pool is dealt into cells around pivots of its own. A product with any vector of a cell is at most that with the pivot, and the vector's length
    times the cell's radius, more; so a row goes to its best cell first, and then only to cells of which that bound is above what it has found. Cells and rows meet in blocks of bounded size. Vectors are all of one dimension.
    """
    spark = rows.sparkSession
    refs = stored(pool.filter(F.col("ref").isNotNull()).select(F.col("ref").cast("array<double>").alias("ref")).distinct(), "pool")
    n = refs.count()
    asked = stored(rows.select(F.monotonically_increasing_id().alias("row"), *keys, F.col(vec).cast("array<double>").alias("vec")), "asked")
    usable = asked.filter("vec IS NOT NULL").select("row", "vec")
    if n <= block:
        shared = spark.sparkContext.broadcast(np.array([r.ref for r in refs.toLocalIterator()], float))

        def whole(batches):
            for batch in batches:
                best = _best(_matrix(batch.column(1)), shared.value) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(np.full(len(best), n))], ["row", "similarity", "compared"])

        found = usable.filter(F.lit(n > 0)).mapInArrow(whole, "row long, similarity double, compared long")
    else:
        found = _by_cells(usable, refs, n)
    return asked.join(found, "row", "left").select(*keys, "similarity", "compared")


def _by_cells(usable: DataFrame, refs: DataFrame, n: int) -> DataFrame:
    spark = usable.sparkSession
    many = min(PIVOTS, math.isqrt(n) + 1)
    pivots = np.array([r.ref for r in refs.orderBy(F.xxhash64("ref"), "ref").limit(many).collect()], float)
    centres = spark.sparkContext.broadcast(pivots)

    def near(batches):
        for batch in _sliced(batches):
            x, p = _matrix(batch.column(0)), centres.value
            cell = ((x * x).sum(1)[:, None] - 2 * (x @ p.T) + (p * p).sum(1)).argmin(1)
            gone = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array(gone)], ["cell", "ref", "gone"])

    cells = stored(refs.mapInArrow(near, "cell int, ref array<double>, gone double"), "cells")
    radius, held = np.zeros(many), np.zeros(many, np.int64)
    for r in cells.groupBy("cell").agg(F.max("gone").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # one a pivot
        radius[r.cell], held[r.cell] = r.radius, r.n
    wide = spark.sparkContext.broadcast((radius, held))

    def dealt(best: bool):
        """Rows to the cells that they must see: the one of the best pivot, or, with what was found there, all others whose bound is above it."""

        def run(batches):
            p, (radius, held) = centres.value, wide.value
            for batch in _sliced(batches):
                x = _matrix(batch.column(1))
                dots = x @ p.T
                first = np.where(held > 0, dots, -np.inf).argmax(1)
                if best:
                    row, cell = np.arange(len(x)), first
                else:
                    above = dots + np.sqrt((x * x).sum(1))[:, None] * radius + SLACK > np.asarray(batch.column(2))[:, None]
                    above[np.arange(len(x)), first] = False
                    row, cell = np.nonzero(above & (held > 0))
                for k in range(0, len(row), HANDED):
                    at = pa.array(row[k : k + HANDED])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell[k : k + HANDED].astype(np.int32))], ["row", "vec", "cell"])

        return lambda df: df.mapInArrow(run, "row long, vec array<double>, cell int")

    def compare(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        v = _matrix(table.column("vec"))
        ours, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        best = _best(v[ours], v[theirs]) if len(ours) and len(theirs) else np.zeros(0)
        ours = ours[: len(best)]
        return pa.table({"row": table.column("row").take(pa.array(ours)), "similarity": pa.array(best), "compared": pa.array(np.full(len(best), len(theirs)))})

    def met(dealt_rows: DataFrame) -> DataFrame:
        sizes = F.broadcast(dealt_rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rows")).join(F.broadcast(cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("refs"))), "cell"))
        place = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
        every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        left = dealt_rows.join(sizes, "cell").select("cell", place("row", "rows").alias("r"), every("refs").alias("k"), F.lit(0).alias("side"), "row", "vec")
        right = cells.join(sizes, "cell").select("cell", every("rows").alias("r"), place("ref", "refs").alias("k"), F.lit(1).alias("side"), F.lit(-1).cast("long").alias("row"), F.col("ref").alias("vec"))
        out = left.unionByName(right).groupBy("cell", "r", "k").applyInArrow(compare, "row long, similarity double, compared long")
        return out.groupBy("row").agg(F.max("similarity").alias("similarity"), F.sum("compared").alias("compared"))

    first = stored(met(stored(dealt(True)(usable), "dealt")), "first")
    rest = stored(dealt(False)(usable.join(first, "row").select("row", "vec", "similarity")), "dealt")
    return first.unionByName(met(rest)).groupBy("row").agg(F.max("similarity").alias("similarity"), F.sum("compared").alias("compared"))


def signals(par: DataFrame, pack: Pack, known: DataFrame, make=None, least: int = 5, strict: bool = True) -> DataFrame:
    """doc_id, p_idx, uniform, intra_sim, human, human_sim: signals of vectors, and what they come from, for sentences.zones_raw(); `known` has the vectors of human texts in a column ref.

    Sentences of at least `least` characters count, and paragraphs of at least LEAST_HUMAN. Where the encoder fails, the query fails, as scores without its signals would look like results; without `strict` they are wanting.
    """
    make = make or lexical_encoder(pack)
    cut = sentences(par, pack).filter(F.col("chars") >= least)
    alike = intra_similarity(encoded(cut, "sentence", make, strict=strict), keys=("doc_id", "p_idx")).select("doc_id", "p_idx", uniform_signal(F.col("similarity")).alias("uniform"), F.col("similarity").alias("intra_sim"))
    long = par.filter(F.length(F.trim("text")) >= LEAST_HUMAN).select("doc_id", "p_idx", "text")
    near = pool_similarity(encoded(long, "text", make, strict=strict), known, ["doc_id", "p_idx"])
    near = near.select("doc_id", "p_idx", human_signal(F.coalesce("similarity", F.lit(-1.0))).alias("human"), F.col("similarity").alias("human_sim"))
    return alike.join(near, ["doc_id", "p_idx"], "full")


def backtrack(par: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, semantic_backtrack_rate: the share of paragraphs, from the third, of whose concepts more than half stood in one before. Not rounded."""
    concepts = par.select("doc_id", "p_idx", F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pack.concept), F.lit(0)))).alias("concept"))
    first = F.min("p_idx").over(Window.partitionBy("doc_id", "concept"))
    seen = concepts.withColumn("seen", F.when(F.col("concept").isNotNull(), (first < F.col("p_idx")).cast("int")))
    each = seen.groupBy("doc_id", "p_idx").agg(F.coalesce(F.avg("seen"), F.lit(0.0)).alias("share"))
    order = Window.partitionBy("doc_id").orderBy("p_idx")
    ranked = each.withColumn("k", F.row_number().over(order))
    n = F.count(F.lit(1))
    late = F.count_if((F.col("k") > 2) & (F.col("share") > 0.5))
    return ranked.groupBy("doc_id").agg(F.when(n >= 3, late / (n - 2)).otherwise(0.0).alias("semantic_backtrack_rate"))


def _vectors(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, shorter ones filled up with 0, and the length of each; -1 for a null one."""
    sizes = np.array([-1 if v is None else len(v) for v in found], int)
    width = int(max(sizes.max(initial=0), 0))
    if len(found) and sizes.min() == width:
        return np.array(found, float).reshape(len(found), width), sizes
    return np.array([[*(v or ()), *[0.0] * (width - max(n, 0))] for v, n in zip(found, sizes.tolist())], float).reshape(len(found), width), sizes


def _summed(a: np.ndarray, b: np.ndarray, part) -> np.ndarray:
    """The sum of part(x, y) over the numbers of each two rows, added up from the first on as SQL does."""
    out = np.zeros(len(a))
    for x, y in zip(a.T.copy(), b.T.copy(), strict=True):
        out += part(x, y)
    return out


#: What walked() finds in each paragraph besides the twelve statistics: names and types.
WALKED = {"near": pa.float64(), "gone": pa.float64(), "met": pa.float64(), "has": pa.bool_(), "seen": pa.float64()}


def walked(par: DataFrame, pack: Pack, make=None, keep: tuple[str, ...] = (), strict: bool = False, rules: bool = False) -> DataFrame:
    """doc_id, p_idx, text, the columns to keep, k, near, gone, met, has, seen, and with `rules` the twelve statistics: all that is counted in texts, in one walk over the paragraphs of each document in order.

    k: the paragraph's number from 1. near, gone: the product of its vector with that of the paragraph before, and the length of the step from there; met: the product of its first sentence's vector with that of the last sentence
    before, 0.5 where they have none; all null for the first. has: whether it has a vector. seen: the share of its concepts that stood in a paragraph before. The engine deals documents out and puts paragraphs in order; a walk
    holds the concepts of one document and the vectors of one batch.
    """
    names = [d[0] for d in RULE_DIMENSIONS] if rules else []
    schema = ", ".join([*(f"{n} double" for n in names), *(f"{n} {'boolean' if t == pa.bool_() else 'double'}" for n, t in WALKED.items())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kernel, known = Kernel(pack), set()
        encode = _encoder(make, strict) if make else None
        vec, last = (np.zeros((1, 0)), np.array([-1])), (np.zeros((1, 0)), np.array([-1]))  # of the row before
        for texts, before, ranks in batches:
            own, n, first = [t or "" for t in texts.to_pylist()], len(texts), np.asarray(ranks) == 1
            tokens, edges = [kernel.tokens(t) for t in own] if rules or not encode else [], [kernel.edges(t) for t in own]
            stats = [kernel.values(t, b, w) for t, b, w in zip(own, before.to_pylist(), tokens)] if rules else []
            ends = [*(a for a, _ in edges), *(b for _, b in edges)]
            found = encode([*own, *ends]) if encode else [*map(kernel.vector, own, tokens), *map(kernel.vector, ends)]
            seen = []
            for t, begins in zip(own, first.tolist()):
                known = set() if begins else known
                concepts = kernel.concepts(t)
                seen.append(len(concepts & known) / len(concepts) if concepts else 0.0)
                known |= concepts

            def beside(one: tuple, other: tuple, part) -> tuple[np.ndarray, np.ndarray]:
                """Of each row with the one before it, and where there is nothing to be said."""
                (a, m), (b, k) = one, other
                width = max(a.shape[1], b.shape[1])
                a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
                return _summed(a, b, part), first | (m != k) | (m < 0)

            (v, m), (f, fm), (e, em) = (_vectors(found[k * n : (k + 1) * n]) for k in range(3))
            follow = lambda old, new, sizes: (np.vstack([np.pad(x, ((0, 0), (0, max(old[0].shape[1], new.shape[1]) - x.shape[1]))) for x in (old[0], new)]), np.concatenate([old[1], sizes]))
            vecs, lasts = follow(vec, v, m), follow(last, e, em)
            near, no = beside((v, m), (vecs[0][:-1], vecs[1][:-1]), lambda x, y: x * y)
            gone, _ = beside((v, m), (vecs[0][:-1], vecs[1][:-1]), lambda x, y: (x - y) * (x - y))
            met, none = beside((f, fm), (lasts[0][:-1], lasts[1][:-1]), lambda x, y: x * y)
            vec, last = (vecs[0][-1:], vecs[1][-1:]), (lasts[0][-1:], lasts[1][-1:])
            columns = [pa.array(c, pa.float64()) for c in zip(*stats)] if stats else [pa.array([], pa.float64()) for _ in names]
            columns += [pa.array(near, mask=no), pa.array(np.sqrt(gone), mask=no), pa.array(np.where(none, 0.5, met), mask=first), pa.array(m >= 0), pa.array(seen, pa.float64())]
            yield pa.StructArray.from_arrays(columns, [*names, *WALKED])

    ranked = par.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("p_idx")))
    before = F.col("prev") if rules else F.lit(None).cast("string")
    rows = ranked.select("doc_id", "p_idx", "text", *keep, "k", F.arrow_udf(run, schema)("text", before, "k").alias("_w"))
    return rows.select("doc_id", "p_idx", "text", *keep, "k", "_w.*")


def _encoded_paragraphs(par: DataFrame, pack: Pack, make, keep: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """doc_id, p_idx, text, the columns to keep, vec, f, l: the vectors of each paragraph, its first and its last sentence, from one call of the encoder for a batch."""
    make = make or lexical_encoder(pack)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kernel, encode = Kernel(pack), _encoder(make, strict)
        for texts in batches:
            own = texts.fillna("").tolist()
            edges, n = [kernel.edges(t) for t in own], len(own)
            found = encode([*own, *(a for a, _ in edges), *(b for _, b in edges)])
            yield pd.DataFrame({"vec": found[:n], "f": found[n : 2 * n], "l": found[2 * n :]}, index=texts.index, dtype=object)

    rows = par.select("doc_id", "p_idx", "text", *keep, F.pandas_udf(run, "vec array<double>, f array<double>, l array<double>")("text").alias("_e"))
    return rows.select("doc_id", "p_idx", "text", *keep, "_e.*")


def _steps(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds what a paragraph has to do with the next one, in one window: similarity, step, transition (0.5 where its sentences have no vectors); null for the last; n: paragraphs of the document."""
    w, whole = Window.partitionBy("doc_id").orderBy("p_idx"), Window.partitionBy("doc_id")
    square = lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))
    out = rows.select("*", F.lead("vec").over(w).alias("_v"), F.lead("f").over(w).alias("_f"), F.lead("p_idx").over(w).alias("_p"), F.count(F.lit(1)).over(whole).alias("n"))
    return out.select(
        "doc_id", "p_idx", "text", *keep, "vec", "n", dot(F.col("vec"), F.col("_v")).alias("similarity"),
        F.sqrt(F.aggregate(F.zip_with("_v", "vec", square), F.lit(0.0), lambda s, x: s + x)).alias("step"),
        F.when(F.col("_p").isNotNull(), F.coalesce(dot(F.col("l"), F.col("_f")), F.lit(0.5))).alias("transition"),
    )


def transitions(par: DataFrame, pack: Pack, make=None) -> DataFrame:
    """doc_id, p_idx, transition: the likeness of a paragraph's last sentence and the next one's first; 0.5 where these have no vectors, null for the last."""
    return _steps(_encoded_paragraphs(par, pack, make)).select("doc_id", "p_idx", "transition")


#: What is said of a document that has no vector evidence.
TOO_SHORT, NOT_ENCODED = "需要至少2个段落", "Embedding encoding failed"


def semantic_documents(par: DataFrame, pack: Pack, make=None) -> DataFrame:
    """doc_id, argument_linearity, semantic_backtrack_rate, error: a row per document; without evidence both are 0 and error says why. Not rounded."""
    steps = _steps(_encoded_paragraphs(par, pack, make)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.var_pop("step").alias("v"), F.count("vec").alias("has"))
    rows = steps.join(backtrack(par, pack), "doc_id")
    error = F.when(F.col("n") < 2, TOO_SHORT).when(F.col("has") < F.col("n"), NOT_ENCODED)
    number = lambda c: F.when(error.isNull() & (F.col("n") >= 3), c).otherwise(0.0)
    return rows.select("doc_id", number(F.col("v")).alias("argument_linearity"), number(F.col("semantic_backtrack_rate")).alias("semantic_backtrack_rate"), error.alias("error"))


def evidence(par: DataFrame, pack: Pack, make=None, keep: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """doc_id, p_idx, text, the columns to keep, evidence: of every paragraph the four vector dimensions as an array of (dim, dim_ord, value, zone, gap), for documents of two paragraphs or
    more of which all have vectors; null for the others. In windows by document the columns to keep ride along.

    The last paragraph has value 0 and zone unknown where its neighbour is wanting. `make` gives an encoder, as in encoded(); without it, words alone make the vectors.
    """
    return judged(walked(par, pack, make, keep, strict), keep)


def judged(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What evidence() gives, from the columns of walked()."""
    w, whole = Window.partitionBy("doc_id").orderBy("p_idx"), Window.partitionBy("doc_id")
    next_ = {"similarity": "near", "step": "gone", "transition": "met"}
    late = F.count_if((F.col("k") > 2) & (F.col("seen") > 0.5))
    rows = rows.select("doc_id", "p_idx", "text", *keep, *(F.lead(c).over(w).alias(n) for n, c in next_.items()), F.count(F.lit(1)).over(whole).alias("n"), F.count_if("has").over(whole).alias("has"), late.over(whole).alias("late"))
    many = F.col("n") >= 3
    linear = F.when(many, F.var_pop("step").over(whole)).otherwise(0.0)
    # rows without an id are no document, whose concepts could come back
    back = F.when(F.col("doc_id").isNotNull(), F.when(many, F.col("late") / (F.col("n") - 2)).otherwise(0.0))
    rows = rows.withColumns({"argument_linearity": linear, "semantic_backtrack_rate": back})
    values = [F.col("similarity"), nearest(F.col("argument_linearity"), 6), nearest(F.col("semantic_backtrack_rate"), 4), F.col("transition")]
    each = []
    for k, (v, d) in enumerate(zip(values, SEMANTIC_DIMENSIONS)):
        v = nearest(v, 4) if k in (0, 3) else v
        each.append(F.struct(F.lit(d[0]).alias("dim"), F.lit(k).alias("dim_ord"), F.coalesce(v, F.lit(0.0)).alias("value"), F.when(v.isNull(), "unknown").otherwise(zone(v, d)).alias("zone"), F.when(v.isNull(), 0.0).otherwise(gap(v, d)).alias("gap")))
    return rows.select("doc_id", "p_idx", "text", *keep, F.when((F.col("n") >= 2) & (F.col("has") == F.col("n")), F.array(*each)).alias("evidence"))


def semantic(par: DataFrame, pack: Pack, make=None, strict: bool = False) -> DataFrame:
    """doc_id, p_idx, dim, dim_ord, value, zone, gap: the evidence as four rows a paragraph that has it."""
    return evidence(par, pack, make, strict=strict).select("doc_id", "p_idx", F.explode("evidence").alias("d")).select("doc_id", "p_idx", "d.*")

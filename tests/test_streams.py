"""Streams of paragraphs with state, against the batch operators on the same paragraphs."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions.packs import LATIN
from quillspark.operators import dimensions as D
from quillspark.operators import sentences as T
from quillspark.streaming import paragraphs as X

SCHEMA = "doc_id long, p_idx int, text string, last boolean"


def made(seed, docs=12):
    rng = random.Random(seed)
    words = "therefore however the of a new crucial plan and city town river house this that indispensable because though".split()
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(2, 14))).capitalize()
    rows = []
    for d in range(docs):
        n = rng.randint(1, 7)
        for p in range(n):
            text = rng.choice([". ".join(sentence() for _ in range(rng.randint(1, 5))) + ".", "Ab. Cd. Ef. Gh. Ij.", "References\nand more of them here. " + sentence() if rng.random() < 0.3 else sentence() + "."])
            rows.append((d, p, text, p == n - 1))
    return rows


def cut(rows, parts, seed):
    """Micro-batches in which each document's paragraphs stay in order over the batches, in any order within one."""
    rng = random.Random(seed)
    at, out = {}, [[] for _ in range(parts)]
    for r in rows:
        at[r[0]] = min(parts - 1, at.get(r[0], 0) + rng.choice([0, 0, 1, 2]))
        out[at[r[0]]].append(r)
    for b in out:
        rng.shuffle(b)
    return out


def drain(spark, make, folder, more):
    """Run the stream over the files that are there, then on over those that come, from the same checkpoint."""
    for k, batch in enumerate(more):
        df = spark.createDataFrame(batch, SCHEMA).coalesce(1)
        df.write.mode("append").parquet(str(folder / "in"))
        time.sleep(0.02)
        if k in (len(more) // 2, len(more) - 1):
            stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")))
            q = stream.writeStream.format("parquet").option("checkpointLocation", str(folder / "at")).trigger(availableNow=True).start(str(folder / "out"))
            q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(folder / "out"))


def key(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).withColumn("score", F.round(columns[-1], 9)).drop(columns[-1] if columns[-1] != "score" else "").collect())


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of each micro-batch starts a worker."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts, seed", [(4, 2)])
def test_zones_under_any_cut(spark, tmp_path, parts, seed):
    rows = made(seed)
    par = spark.createDataFrame(rows, SCHEMA)
    want = T.propagated(T.zones_raw(par.drop("last"), LATIN))
    got = drain(spark, X.zones, tmp_path, cut(rows, parts, seed))
    columns = ("doc_id", "p_idx", "s_idx", "chars", "zone", "score")
    assert key(got, *columns) == key(want, *columns) != []
    assert {r.zone for r in got.select("zone").collect()} > {"green", "orange"}


@pytest.mark.parametrize("parts, seed", [(2, 4)])
def test_levels_under_any_cut(spark, tmp_path, parts, seed):
    rows = made(seed)
    par = spark.createDataFrame(rows, SCHEMA)
    before = par.withColumn("prev", F.coalesce(F.lag("text").over(Window.partitionBy("doc_id").orderBy("p_idx")), F.lit("")))
    want = D.scanned(before.drop("last"), LATIN)
    got = drain(spark, X.levels, tmp_path, cut(rows, parts, seed))
    columns = ("doc_id", "p_idx", "ai_count", "level", "comprehensive_score")
    assert key(got, *columns) == key(want, *columns) != []


def test_a_document_is_closed_when_nothing_comes(spark, tmp_path):
    rows = [(1, 0, "Therefore the city is crucial. However this is so.", False), (2, 0, "A house by the river. And then no more of it.", True)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = X.zones(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), idle=1)
    q = stream.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="300 milliseconds").start()
    try:
        # timers fire in batches without data, so there is no end to wait for
        end, n = time.time() + 60, 0
        while n < 4 and time.time() < end and q.isActive:
            time.sleep(0.5)
            n = spark.table("closed").count()
        par = spark.createDataFrame(rows, SCHEMA).drop("last")
        columns = ("doc_id", "p_idx", "s_idx", "chars", "zone", "score")
        assert key(spark.table("closed"), *columns) == key(T.propagated(T.zones_raw(par, LATIN)), *columns)
    finally:
        q.stop()


def test_step_by_step_is_the_window(spark):
    rng = random.Random(9)
    rows = [(d, s, rng.choice(["green", "green", "yellow", "orange", "red"]), rng.choice([0.0, 0.1, 0.3])) for d in range(60) for s in range(rng.randint(1, 9))]
    df = spark.createDataFrame([(d, 0, s, z, x) for d, s, z, x in rows], "doc_id long, p_idx int, s_idx int, zone string, score double")
    want = {(r.doc_id, r.s_idx): (r.zone, r.score) for r in T.propagated(df).collect()}
    got = {}
    for d in range(60):
        own, before = [r for r in rows if r[0] == d], None
        for k, (_, s, z, x) in enumerate(own):
            got[d, s] = T.spread_step(before, z, x, own[k + 1][2] if k + 1 < len(own) else None)
            before = got[d, s][0]
    assert got == want

import random
from types import SimpleNamespace

import corpus_pipeline as c
import numpy as np
import pytest

from quillspark import llm
from quillspark.llm import _filters, _shared
from quillspark.llm._words import WHITE, Words, draw, mix

SF = "/root/testdata/sf0.001"


def test_off_local_mode_a_shared_folder_must_be_named():
    conf = SimpleNamespace(get=lambda *_: None)
    spark = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="a"), conf=conf)
    with pytest.raises(ValueError):
        _shared.shared_dir(spark)
    conf.get = lambda *_: "hdfs:///shared/"
    assert _shared.shared_dir(spark) == "hdfs:///shared"


def test_results_stay_readable_until_released(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, second = c.near(spark, docs, SF), c.clean(spark, docs, SF)
    near = c.near(spark, second, SF)
    assert 0 < near.count() <= second.count() and first.count() > 0
    assert _shared.made()
    llm.release(spark)
    assert not _shared.made()


def test_filters(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(5000)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    f = _filters.Filter(df, 32)
    assert f.has(np.array(keys).view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    assert f.has(others).mean() < 0.1 and len(f.map) * 8 <= 32 * 5000 * 4
    assert _filters.Filter.fits(df, 32) and not _filters.Filter.fits(df, 12)
    assert not _filters.Filter(df.limit(0), 32).has(others).any()


def test_levels(spark):
    rows = [(1, 5), (2, 10), (3, 11), (4, 161), (5, 3000)]
    of = _filters.Levels(spark.createDataFrame([(int(mix(np.array([k], np.uint64)).view(np.int64)[0]), n) for k, n in rows], "key long, n long"), 10, 32)
    got = of.of(mix(np.arange(1, 6, dtype=np.uint64))).tolist()
    assert got == [1, 1, 16, 256, 4096]
    assert all(n <= 10 * cells for (_, n), cells in zip(rows, got))


def test_words_against_a_loop():
    prime = (1 << 61) - 1
    rng = random.Random(3)
    words = ["".join(rng.choices("abcé漢\x00", k=rng.randint(1, 60))) for _ in range(300)] + ["x" * 447, "x" * 448]
    texts = [" ".join(words[k : k + 7]) for k in range(0, len(words), 7)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    place = draw()
    got = Words(raw, at, WHITE, place)
    want = []
    for w in words:
        b = w.encode()
        h = len(b)
        for k in range(0, len(b), 7):
            h = (h * place + int.from_bytes(b[k : k + 7], "little")) % prime
        want.append(int(mix(np.array([h * place % prime ^ 0x5851F42D4C957F2D], np.uint64))[0]))
    assert got.hash.tolist() == want
    assert got.counts().tolist() == [len(t.split(" ")) for t in texts]

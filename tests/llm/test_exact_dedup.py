import hashlib
import re

import oracle
from pyspark.sql import functions as F
from quillspark.llm import exact_dedup as x

ROWS = [
    (1, "a b"),
    (2, "ab"),
    (3, " a  b\n"),
    (4, None),
    (5, ""),
    (6, " \t\x0b\x0c\r"),
    (7, "x" * 5000 + ". " + "y" * 300),
    (8, "x" * 5000 + "." + "y" * 300),
    (8, "x" * 5000 + "." + "y" * 300),
    (None, "ab"),
    (9, "a b"),
    (10, "漢字。" * 2000),
    (11, "漢字。 " * 2000),
    (12, "漢字。" * 2000 + "!"),
]


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for name, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), name is None, name))
    out = []
    for name, t in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda r: (r[0], r[1], r[2] or 0))[2]
        out.append((name, keep, len(g), name == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_small(spark):
    docs = spark.createDataFrame([(*r, "q") for r in ROWS], "doc_id long, text string, keep_id string")
    assert sorted(map(tuple, x.exact_dedup(docs).collect()), key=repr) == brute(ROWS)
    assert x.exact_dedup(docs.limit(0)).count() == 0


def test_colliding_identifiers_are_replaced(spark, sf):
    weak = [lambda c: F.pmod(F.xxhash64(c), F.lit(3)), lambda c: F.length(c), lambda c: c]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parts = docs.select(x.chunks(F.col("text"), 512, 4096).alias("parts"))
    assert not x.verified(parts, weak[0])
    got = x.exact_dedup(docs, identifiers=weak)
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_oracle(spark, sf):
    oracle.same(x.op1_exact_dedup(spark, sf), x.ORACLES["op1_exact_dedup"], oracle.connect(sf))


def test_native(spark, sf, monkeypatch):
    monkeypatch.setattr(x, "written", lambda df, name: df)  # so that the plan is in one piece
    plan = x.op1_exact_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "regexp_extract_all" in plan

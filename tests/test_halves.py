"""Numbers that lie on bounds or halves: the same side as SQL."""

import json
import random

import duckdb
from pyspark.sql import functions as F

from quillspark.functions.packs import LATIN
from quillspark.functions.text import deviation, fixed, nearest
from quillspark.operators import dimensions as D
from quillspark.operators.kernels import Kernel, entropy, spread
from quillspark.sources import sinks


def test_shares_of_halves_and_quarters_give_exact_bits():
    assert [entropy(c, sum(c)) for c in ([14, 7, 7], [5] * 4, [18, 9, 9], [7] * 8)] == [1.5, 2.0, 1.5, 3.0]


def test_densities_at_a_bound():
    """Eight connectors in a thousand characters are at the bound, for each length that gives them."""
    word = LATIN.connectors["medium"][0]
    for n in (1, 3, 6, 7):
        text = f"{word} " * n
        text += "x" * (125 * n - len(text))
        assert Kernel(LATIN).values(text, None)[1] == 8.0


def test_deviation_has_the_last_bit_of_sql(spark):
    rnd = random.Random(3)
    rows = [(k, [rnd.randint(10, 40) for _ in range(rnd.randint(3, 9))]) for k in range(1500)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(k INT, x INT[])")
    con.executemany("INSERT INTO t VALUES (?, ?)", [list(r) for r in rows])
    want = dict(con.execute("SELECT k, list_aggregate(x, 'stddev_pop') FROM t").fetchall())
    assert {k: spread(x) for k, x in rows} == want
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in rows], "k int, x array<double>")
    assert {r.k: r.v for r in df.select("k", deviation(F.col("x")).alias("v")).collect()} == want


def test_numbers_are_rounded_and_written_as_by_sql(spark):
    rnd = random.Random(5)
    own = [4.25, 4.35, 0.25, 0.285, 1.00495, 0.0015625, 7.75, 12.0, 2.675] + [rnd.randint(1, 20000) / rnd.choice([640, 3200, 1000, 160, 64, 20000]) for _ in range(3000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(k INT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [[k, x] for k, x in enumerate(own)])
    want = con.execute("SELECT k, round(x, 4), round(x, 2), printf('%.1f', x), printf('%.2f', x) FROM t ORDER BY k").fetchall()
    df = spark.createDataFrame(list(enumerate(own)), "k int, x double")
    x = F.col("x")
    got = df.select("k", nearest(x, 4), nearest(x, 2), fixed(x, 1), fixed(x, 2)).orderBy("k").collect()
    assert [(g, w) for g, w in zip(map(tuple, got), want) if g != w] == []


def test_small_gaps_have_no_exponent_and_texts_stay(spark):
    text = 'time:1.50,} 5.0E-4 "q" \\ and more'
    names = [d[0] for d in D.RULE_DIMENSIONS]
    values = {n: 0.0 for n in names} | {"hapax_ratio": 0.3496, "slop_density": 3.0, "info_density": 0.6}
    dims = spark.createDataFrame([(1, 0, text, *values.values(), 0.0005, "green")], ["doc_id", "p_idx", "text", *names, "comprehensive_score", "level"])
    dims = dims.withColumn("hapax_ratio", F.lit(0.35)).withColumn("bigram_repetition", F.lit(0.08)).withColumn("trigram_repetition", F.lit(0.0))
    found = sinks.json_rows(dims).collect()[0].json
    assert '"comprehensive_score":0.0005,' in found and "E-" not in found.replace(json.dumps(text), "")
    assert json.loads(found)["text_preview"] == text
    again = sinks.json_rows(dims, rewrites=spark.createDataFrame([(1, 0, "{n}ew}")], "doc_id int, p_idx int, rewrite string")).collect()[0].json
    assert json.loads(again) == json.loads(found) | {"rewrite": "{n}ew}"}

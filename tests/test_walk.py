"""Both layers of a fused scan come from one walk over each document."""

from pyspark.sql import functions as F

from quillspark.functions.packs import LATIN, ZH
from quillspark.operators import dimensions as D
from quillspark.operators import parse as P
from quillspark.operators import semantic as V
from quillspark.plans import registry

SF = "/root/testdata/sf0.001"
ODD = ["One line alone of enough signs.", "", None, "Common concepts return here.\nCommon concepts return here.\nsomething different entirely\nreturn different concepts; something", "\n".join(["...........", "12345678901 x", "İstanbul straße œuvre ΑΣΣ", "a b c d e f g h i j k"] * 2)]


def test_a_fused_scan_reads_and_counts_each_text_once(spark):
    for name, more in (("sql_fused", 2), ("fused_levels", 2)):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
        assert plan.count("ArrowEvalPython [") == 1 and plan.count("FileScan parquet") == 1 and "Join" not in plan, name
        # texts move as documents are dealt, if at all; afterwards only what was found in them
        assert plan.count("Exchange") <= more + 1, name


def test_the_walk_finds_what_windows_and_joins_find(spark):
    def uneven():  # vectors of several lengths
        return lambda texts: [[float(len(t)), 1 / (1 + t.count("e")), 0.1 * t.count("a")][: 2 + len(t) % 2] for t in texts]

    def broken():
        raise ValueError("no model")

    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    docs = odd.union(spark.read.parquet(f"{SF}/documents.parquet").limit(60).select(F.col("doc_id") + 100, "text"))
    for pack in (LATIN, ZH):
        for make in (None, uneven, broken):
            par = P.paragraphs(docs, pack)
            got = V.walked(par, pack, make, rules=True)
            steps = V._steps(V._encoded_paragraphs(par, pack, make))
            want = sorted((r.doc_id, r.p_idx, r.similarity, r.step, r.transition, r.vec is not None) for r in steps.collect())
            rows = {(r.doc_id, r.p_idx): r for r in got.collect()}
            after = [rows.get((d, p + 1)) for d, p, *_ in want]
            mine = [(d, p, *((n.near, n.gone, n.met) if n else (None,) * 3), rows[d, p].has) for (d, p, *_), n in zip(want, after, strict=True)]
            assert list(map(repr, mine)) == list(map(repr, want)), (pack.name, make)
            late = {}
            for (d, p), r in rows.items():
                late[d] = late.get(d, 0) + (r.k > 2 and r.seen > 0.5)
            rates = {r.doc_id: r.semantic_backtrack_rate for r in V.backtrack(par, pack).collect()}
            n = {d: sum(k[0] == d for k in rows) for d in late}
            assert rates == {d: late[d] / (n[d] - 2) if n[d] >= 3 else 0.0 for d in late}
            names = [x[0] for x in D.RULE_DIMENSIONS]
            assert {(r.doc_id, r.p_idx): [r[c] for c in names] for r in D.dimensions(par, pack).collect()} == {k: [r[c] for c in names] for k, r in rows.items()}

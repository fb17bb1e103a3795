"""The detector: compiled forests against the learnt ones, bundles that come back whole, and the scan that it decides."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quillspark.functions.packs import ZH
from quillspark.operators import parse as P
from quillspark.operators import scoring as C
from quillspark.operators import sentences as T

N = len(C.FEATURES)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, N)).round(3)
    label = (x[:, 0] + x[:, 4] + 0.3 * rng.random(600) > 1.1).astype(float)
    return spark.createDataFrame([(k, Vectors.dense(v), float(y)) for k, (v, y) in enumerate(zip(x, label, strict=True))], ["id", "features", "label"]).cache()


@pytest.fixture(scope="module")
def forest(rows):
    return C.train(rows)


def probabilities(df):
    return {r.id: r.probability for r in df.select("id", "probability").collect()}


def test_compiled_forest_gives_what_the_learnt_one_gives(rows, forest, monkeypatch):
    want = {r.id: r.p for r in forest.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    got = C.Detector.of(forest).transform(rows)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert probabilities(got) == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(C, "MOST_NODES", 10)  # a large one goes over batches
    large = C.Detector.of(forest).transform(rows)
    assert "Python" in large._jdf.queryExecution().executedPlan().toString()
    assert probabilities(large) == pytest.approx(want, abs=1e-12)


def test_zones_by_cuts(rows, forest):
    d = C.Detector.of(forest, {"red_threshold": 0.9, "orange_threshold": 0.5, "yellow_threshold": 0.2, "red_weight": 1.0, "orange_weight": 0.5, "yellow_weight": 0.25})
    seen = set()
    for r in d.transform(rows).collect():
        p = round(r.probability, 6)
        assert r.zone == ("red" if p >= 0.9 else "orange" if p >= 0.5 else "yellow" if p >= 0.2 else "green")
        seen.add(r.zone)
    assert len(seen) == 4
    zones = d.transform(rows).selectExpr("id % 5 AS doc_id", "1 + id % 7 AS chars", "zone")
    want = {}
    for r in zones.collect():
        own = want.setdefault(r.doc_id, [0.0, 0])
        own[0] += r.chars * {"red": 1.0, "orange": 0.5, "yellow": 0.25, "green": 0.0}[r.zone]
        own[1] += r.chars
    assert {r.doc_id: r.weighted_rate for r in d.weighted_rate(zones).collect()} == pytest.approx({k: a / b for k, (a, b) in want.items()})


def test_bundle_comes_back_whole(spark, rows, forest, tmp_path):
    found = {"red_threshold": 0.7, "orange_threshold": 0.5, "yellow_threshold": 0.3, "red_weight": 1.0, "orange_weight": 0.6, "yellow_weight": 0.2}
    (tmp_path / "cuts.json").write_text(json.dumps(found, indent=1))
    assert C.read_cuts(spark, str(tmp_path / "cuts.json")) == found
    (tmp_path / "bad.json").write_text('{"red_threshold": 0.7}')
    with pytest.raises(ValueError):
        C.read_cuts(spark, str(tmp_path / "bad.json"))
    d = C.Detector.of(forest, found)
    d.write().overwrite().save(str(tmp_path / "detector"))
    again = C.Detector.load(str(tmp_path / "detector"))
    assert again.extractParamMap().values().__len__() == d.extractParamMap().values().__len__()
    assert [tuple(r) for r in again.transform(rows).collect()] == [tuple(r) for r in d.transform(rows).collect()]
    # as a stage of a pipeline too
    model = Pipeline(stages=[d]).fit(rows)
    model.write().overwrite().save(str(tmp_path / "pipeline"))
    assert probabilities(PipelineModel.load(str(tmp_path / "pipeline")).transform(rows)) == probabilities(d.transform(rows))


def test_a_detector_of_other_features_is_refused(rows):
    with pytest.raises(ValueError):
        C.Detector(trees="[0.5]", version=C.VERSION - 1).transform(rows)
    assert rows.count() == C.Detector.of([]).transform(rows).filter("probability IS NULL AND zone = 'green'").count()


TEXTS = [
    "因此，这个方法很重要，综上所述值得注意的是它的作用。此外，这意味着研究具有重要的理论意义和现实意义。\n\n窗外下着雨，我想起母亲说过的那句话，心里一下子就静了下来，灯火慢慢暗下去。\n\n参考文献\n[1] 张三，城市治理研究，北京大学出版社，2020年。",
    "短。",
]


def test_scan_by_a_detector(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    par = P.paragraphs(docs, ZH)
    tree = (C.FEATURES.index("medium_connectors"), 0.1, 0.1, 0.9)
    got = T.zones_raw(par, ZH, model=C.Detector.of([tree])).orderBy("p_idx", "s_idx").collect()
    rules = T.zones_raw(par, ZH).orderBy("p_idx", "s_idx").collect()
    assert len(got) == len(rules) > 3
    for g, r in zip(got, rules, strict=True):
        if r.reasons == ["参考文献(保护)"]:
            assert (g.zone, g.score, g.reasons, g.ai_dim_count) == ("green", 0.0, r.reasons, 0)
            continue
        hit = any(c in g.sentence for c in ZH.connectors["medium"])
        assert (g.score, g.zone) == ((0.9, "red") if hit else (0.1, "green"))
        # the same reasons but the last of first sentences
        told = [x for x in g.reasons if not x.startswith("ML(")]
        assert told == [x for x in r.reasons if x != "段首句"] and g.ai_dim_count == len(g.reasons)
        assert (g.s_idx == 0) == any(x in ("ML(90%)", "ML(10%)") for x in g.reasons)
    spread = T.propagated(T.zones_raw(par, ZH, model=C.Detector.of([tree])))
    assert T.document_summary(spread).first().red_count == sum(g.zone == "red" for g in got)


def test_every_paragraph_foretells_itself_in_a_scan(spark):
    """A paragraph of few words said again and again is more suspect than one of ever new words, by self-perplexity alone."""
    same = "，".join(["城市治理需要数据平台支持"] * 6)
    docs = spark.createDataFrame([(0, same)], "doc_id int, text string")
    par = P.paragraphs(docs, ZH)
    told = T.self_perplexity(par, ZH).first()
    assert 0 < told.self_ppl < 12 and told.new_word_ratio == 0
    row = T.zones_raw(par, ZH).first()
    assert "perplexity" in row.signals and any(x.startswith("低困惑度:自洽(self_ppl=") for x in row.reasons)
    none = par.select("doc_id", "p_idx", F.lit(0.0).alias("own"))
    assert row.score - T.zones_raw(par, ZH, none).first().score == pytest.approx(0.10 + 0.05 if told.self_ppl < 6 else 0.05 + 0.05)

"""A query whose encoder fails fails; it does not give scores without the signals of vectors."""

import pytest

from quillspark.functions.packs import LATIN
from quillspark.operators import semantic as V
from quillspark.plans import registry

SF = "/root/testdata/sf0.001"
TEXTS = ["The first paragraph stands here. It has two sentences.", "A second one follows the first. It says more than that."]


def _failing():
    def make():
        def run(texts):
            raise RuntimeError("no vectors today")

        return run

    return make


def _broken(word: str):
    def make():
        plain = V.lexical_encoder(LATIN)()

        def run(texts):
            if any(word in t for t in texts):
                raise RuntimeError("no vectors today")
            return plain(texts)

        return run

    return make


@pytest.mark.parametrize("name", ["sentence_zones_vectors", "model_zones", "sentence_features"])
def test_queries_fail_with_their_encoder(spark, monkeypatch, name):
    monkeypatch.setattr(V, "lexical_encoder", lambda pack: _failing())
    with pytest.raises(Exception, match="no vectors today"):
        registry.QUERIES[name](spark, SF).collect()


def test_signals_fail_by_either_encoding(spark):
    """Of sentences, and of paragraphs alone: the white space between sentences stands in no sentence."""
    par = spark.createDataFrame(list(enumerate(TEXTS)), "p_idx int, text string").selectExpr("CAST(1 AS long) AS doc_id", "p_idx", "text")
    known = V.encoded(par, "text", V.lexical_encoder(LATIN), "ref").select("ref")
    assert V.signals(par, LATIN, known).count() == 2
    for word in ("It has two", "here. It"):
        with pytest.raises(Exception, match="no vectors today"):
            V.signals(par, LATIN, known, _broken(word)).collect()


def test_failures_are_counted_where_they_are_asked_for(spark):
    par = spark.createDataFrame(list(enumerate(TEXTS)), "p_idx int, text string")
    with pytest.raises(Exception, match="no vectors today"):
        V.encoded(par, "text", _failing()).collect()
    assert V.failures(V.encoded(par, "text", _failing(), strict=False)).first() == (2, 2)

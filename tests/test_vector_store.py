"""Vectors kept by content: encoded once, published whole."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions.packs import LATIN
from quillspark.operators import dimensions as D
from quillspark.operators import semantic as V
from quillspark.operators import vector_store as X

ROWS = [(1, 0, "alpha beta gamma delta", ""), (1, 1, "alpha beta gamma delta", "alpha beta gamma delta"), (1, 2, "other words stand here", "alpha beta gamma delta"), (2, 0, "alpha beta gamma delta", ""), (2, 1, None, "alpha beta gamma delta")]


def counting(folder):
    """An encoder that leaves a line for each text it gets."""

    def make():
        plain = V.lexical_encoder(LATIN)()

        def run(texts):
            with open(f"{folder}/seen", "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return plain(texts)

        return run

    return make


def test_each_text_is_encoded_once(spark, tmp_path):
    par = spark.createDataFrame(ROWS, "doc_id long, p_idx int, text string, prev string")
    seen = lambda: sorted((tmp_path / "seen").read_text().split("\n")[:-1]) if (tmp_path / "seen").exists() else []
    store = X.VectorStore(spark, str(tmp_path / "store"), "one", counting(tmp_path))
    rows = store.with_vectors(par, {"vec": "text", "before": "prev"}).collect()
    assert seen() == ["", "alpha beta gamma delta", "other words stand here"]
    plain = V.lexical_encoder(LATIN)()
    assert all(list(r.vec) == plain([r.text or ""])[0] and list(r.before) == plain([r.prev])[0] for r in rows) and len(rows) == 5
    # a second run, and another process's store of the same version, encode nothing
    assert store.fill(par, "text", "prev") == 0 == X.VectorStore(spark, str(tmp_path / "store"), "one", counting(tmp_path)).fill(par, "text")
    more = spark.createDataFrame([("a new text",), ("alpha beta gamma delta",)], "text string")
    assert store.fill(more, "text") == 1 and len(seen()) == 4
    assert store.kept().count() == 4
    # another version starts anew
    assert X.VectorStore(spark, str(tmp_path / "store"), "two", counting(tmp_path)).fill(more, "text") == 2


def test_what_a_failed_run_left_is_no_part_of_it(spark, tmp_path):
    def make():
        return lambda texts: 1 / 0

    par = spark.createDataFrame(ROWS, "doc_id long, p_idx int, text string, prev string")
    store = X.VectorStore(spark, str(tmp_path), "v", make, strict=True)
    with pytest.raises(Exception):  # noqa: B017  whatever the encoder raises
        store.fill(par, "text")
    assert store.kept().count() == 0
    lenient = X.VectorStore(spark, str(tmp_path), "v", make)
    assert lenient.fill(par, "text") == 0 and lenient.with_vectors(par, {"vec": "text"}).filter("vec IS NOT NULL").count() == 0
    good = X.VectorStore(spark, str(tmp_path), "v", V.lexical_encoder(LATIN))
    assert good.fill(par, "text") == 3


def test_statistics_use_it(spark, tmp_path):
    par = spark.createDataFrame(ROWS, "doc_id long, p_idx int, text string, prev string")
    store = X.VectorStore(spark, str(tmp_path), "v", V.lexical_encoder(LATIN))
    got = {(r.doc_id, r.p_idx): r.paragraph_similarity for r in X.dimensions(par, LATIN, store).collect()}
    assert got[1, 0] == got[2, 0] == got[2, 1] == 0.0 and got[1, 1] == pytest.approx(1) and 0 <= got[1, 2] < 1
    plain = D.dimensions(par, LATIN)
    assert X.dimensions(par, LATIN, store).columns == plain.columns
    drop = lambda df: sorted(map(tuple, df.drop("paragraph_similarity").withColumn("text", F.coalesce("text", F.lit(""))).collect()))
    assert drop(X.dimensions(par, LATIN, store)) == drop(plain)

"""The data source of text files: batches, streams, damaged files, and writes that are killed."""

import io
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files as X
from quillspark.sources.stored import place

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


CONTENT = {
    "a.txt": "plain text".encode(),
    "empty.txt": b"",
    "gbk.txt": ("中文内容，" * 30).encode("gbk"),
    "two.docx": docx("one", "two"),
    "broken.docx": b"PK no archive",
    "sub/deep%20name.txt": "déjà".encode(),
    "other.log": b"left out",
    "_hidden.txt": b"no",
}
WANT = {"a": "plain text", "empty": "", "gbk": "中文内容，" * 30, "two": "one\n\ntwo", "broken": None, "deep name": "déjà"}


@pytest.fixture
def folder(spark, tmp_path):
    X.register(spark)
    for name, data in CONTENT.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
        os.utime(tmp_path / name, (1_700_000_000, 1_700_000_000))
    return tmp_path


def read(spark, path, **options):
    return spark.read.format("textfiles").options(pattern="*.txt,*.docx", **options).load(str(path))


@pytest.mark.parametrize("bytes_", [1, 10**9])
def test_batch(spark, folder, bytes_):
    df = read(spark, folder, partitionBytes=bytes_)
    rows = df.collect()
    assert {r.name: r.text for r in rows} == WANT and len(rows) == len(WANT)
    assert [r.name for r in rows if r.error] == ["broken"] and all(r.n_bytes == len(CONTENT[os.path.relpath(r.path, folder)]) for r in rows)
    assert df.rdd.getNumPartitions() == (len(WANT) if bytes_ == 1 else 1)


def test_columns_that_are_not_asked_for_are_not_made(spark, folder, monkeypatch):
    names = spark.read.format("textfiles").schema("name string, n_bytes long").option("pattern", "*.txt").load(str(folder))
    os.chmod(folder / "a.txt", 0)
    assert sorted(r.name for r in names.collect()) == ["a", "deep name", "empty", "gbk"]
    opened = []
    monkeypatch.setattr(X, "text_of", lambda *a: opened.append(a))
    reader = X._Reader(names.schema, {"path": str(folder)})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 7 and not opened


def test_filters_leave_files_out(spark, folder):
    df = read(spark, folder)
    assert [r.text for r in df.filter("name = 'a'").collect()] == ["plain text"]
    assert sorted(r.name for r in df.filter(F.col("name").isin("a", "two") & (F.col("n_bytes") > 0)).collect()) == ["a", "two"]
    assert [r.name for r in df.filter(F.col("path").endswith("two.docx")).collect()] == ["two"]
    reader = X._Reader(df.schema, {"path": str(folder)})
    assert list(reader.pushFilters([X.EqualTo(("name",), "a"), other := X.EqualTo(("n_bytes",), 1)])) == [other]
    assert [f.path for p in reader.partitions() for f in p.files] == [f"{folder}/a.txt"]


def test_named_encodings(spark, folder):
    (folder / "latin.txt").write_bytes("é".encode("latin-1") * 200)
    get = lambda **o: {r.name: (r.text, bool(r.error)) for r in read(spark, folder, **o).collect()}
    assert get(encoding="latin-1")["latin"] == ("é" * 200, False)
    assert get(encoding="utf-8")["latin"] == (None, True) and get(encoding="utf-8")["deep name"] == ("déjà", False)


def test_patterns_single_files_and_nothing(spark, folder):
    get = lambda p: sorted(r.name for r in spark.read.format("textfiles").load(p).select("name").collect())
    assert get(f"{folder}/*.docx") == ["broken", "two"] and get(f"file://{folder}/a.txt") == ["a"]
    (folder / "none").mkdir()
    assert get(f"{folder}/none") == []
    with pytest.raises(Exception, match="does not exist"):
        get(f"{folder}/nowhere")


def test_stream_and_batch_give_equal_rows(spark, folder, tmp_path_factory):
    at = tmp_path_factory.mktemp("stream")

    def drain():
        stream = spark.readStream.format("textfiles").options(pattern="*.txt,*.docx", settle=0).load(str(folder))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(at / "checkpoint")).trigger(processingTime="200 milliseconds").start(str(at / "rows"))
        q.processAllAvailable()
        q.stop()
        return spark.read.schema(X.SCHEMA).parquet(str(at / "rows"))

    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(drain()) == key(read(spark, folder))
    time.sleep(0.1)
    (folder / "later.txt").write_text("came later")
    time.sleep(0.3)
    # a restart goes on from the offset: the new file once, the others not again
    assert key(drain()) == key(read(spark, folder)) and key(drain()) == key(read(spark, folder))


def test_files_are_written_and_read(spark, tmp_path):
    X.register(spark)
    rows = [("a/b", "one\ntwo"), ("c", None), ("c", "again"), (None, "no name"), ("漢 字%", "x" * 100_000)]
    df = spark.createDataFrame(rows, "name string, text string").repartition(3)
    df.write.format("textfiles").mode("append").save(str(tmp_path / "out"))
    got = sorted((r.name.partition("~")[0], r.text) for r in spark.read.format("textfiles").load(str(tmp_path / "out")).collect())
    assert got == sorted((n or "", t or "") for n, t in rows)
    (own,) = X.manifest(str(tmp_path / "out"))
    assert own["rows"] == own["files"] == 5 and own["n_bytes"] == sum(len((t or "").encode()) for _, t in rows)


def test_lines_append_and_overwrite(spark, tmp_path):
    X.register(spark)
    out = str(tmp_path / "out")
    make = lambda *x: spark.createDataFrame([(t,) for t in x], "text string").repartition(2)
    get = lambda: sorted(r.value for r in X.lines(spark, out).collect())
    make("a", "b").write.format("textfiles").mode("append").save(out)
    make("c\nd").write.format("textfiles").mode("append").save(out)
    assert get() == ["a", "b", "c d"] and len(X.manifest(out)) == 2
    make("e").write.format("textfiles").mode("overwrite").save(out)
    assert get() == ["e"] and len(X.manifest(out)) == 1
    assert len([p for p in (tmp_path / "out").iterdir() if p.name != X.MANIFESTS]) == 1
    make().write.format("textfiles").mode("overwrite").save(out)
    assert get() == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    X.register(spark)
    out = str(tmp_path / "out")
    spark.createDataFrame([("old",)], "text string").write.format("textfiles").mode("append").save(out)

    @F.udf("string")
    def fails(k):
        if k == 1999:
            raise RuntimeError("killed")
        return str(k)

    df = spark.range(0, 2000, 1, 4).select(fails("id").alias("text"))
    with pytest.raises(Exception, match="killed"):
        df.write.format("textfiles").mode("overwrite").save(out)
    assert [r.value for r in X.lines(spark, out).collect()] == ["old"]
    assert len([p for p in (tmp_path / "out").iterdir() if p.name != X.MANIFESTS]) == 1


def test_what_a_killed_attempt_left_is_not_read(spark, tmp_path):
    """A worker that dies in the middle leaves its folder: no manifest names it, and the commit of the write removes it."""
    X.register(spark)
    schema = spark.createDataFrame([], "text string").schema
    w = X._Writer(schema, {"path": str(tmp_path / "out")}, False)
    dead = tmp_path / "out" / w.job / "00000-7"
    dead.mkdir(parents=True)
    (dead / "part.txt").write_text("half a li")
    good = tmp_path / "out" / w.job / "00000-8"
    good.mkdir()
    (good / "part.txt").write_text("whole line\n")
    w.commit([X.Part(f"{w.job}/00000-8", 1, 1, 11), None])
    assert not dead.exists() and [r.value for r in X.lines(spark, str(tmp_path / "out")).collect()] == ["whole line"]


def test_wrong_columns(spark, tmp_path):
    X.register(spark)
    with pytest.raises(Exception, match="writes a column text"):
        spark.createDataFrame([(1,)], "id int").write.format("textfiles").mode("append").save(str(tmp_path / "x"))
    assert place(spark, "x")

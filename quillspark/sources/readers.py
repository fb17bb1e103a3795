"""Sources: text files, docx files, files of unknown encoding, reference corpora, lexicons."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


#: Texts that one task counts, about.
TEXTS = 10_000


def spread(rows: DataFrame, key: str | None = None, most: int = TEXTS) -> DataFrame:
    """The rows over as many partitions as there are cores, and `most` rows give work to one, if the scan gives fewer: a small file of one row group is one task, and counting takes far longer than
    the bytes tell by which scans and shuffles are cut. Otherwise a table stays as it is scanned. With a key, rows are dealt by it in any case; windows by that key then move them no more.
    """
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))
    if key:
        return rows.repartition(n, key)
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: each file whole, in UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def decode(content: bytes) -> str:
    """As UTF-8, or as GBK where that gives over ten replacement signs, or a text of over a hundred signs without a Chinese one."""
    text = content.decode("utf-8", "replace")
    odd = text.count("\ufffd") > 10 or len(text) > 100 and not re.search("[一-鿿]", text)
    return content.decode("gbk", "replace") if odd else text


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: each file whole, decoded as decode() does. The engine's own decoding of damaged bytes is a setting of the whole session, so it is not used."""
    run = F.pandas_udf(lambda contents: contents.map(lambda c: decode(bytes(c))), "string")
    return spark.read.format("binaryFile").load(path).select("path", run("content").alias("text"))


def docx_paragraphs(content: bytes) -> list[tuple[int, str, str]]:
    """(number, style, text) of each paragraph that is not empty; the style's name where the file has it."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else s.get(f"{_W}styleId")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else []:
        parts = []
        for x in p.iter():
            if x.tag == f"{_W}t":
                parts.append(x.text or "")
            elif x.tag == f"{_W}tab":
                parts.append("\t")
            elif x.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        text = "".join(parts).strip()
        if text:
            style = p.find(f"{_W}pPr/{_W}pStyle")
            own = style.get(f"{_W}val") if style is not None else None
            out.append((len(out), names.get(own, own) if own else "Normal", text))
    return out


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """path, p_idx, style, text: the paragraphs of each docx file; a damaged file gives one row with an error."""

    def run(frames):
        for frame in frames:
            rows = []
            for path_, content in zip(frame["path"], frame["content"]):
                try:
                    rows += [(path_, *p, None) for p in docx_paragraphs(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((path_, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "p_idx", "style", "text", "error"]).astype({"p_idx": "Int64"})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(run, "path string, p_idx long, style string, text string, error string")


def documents_from(spark: SparkSession, source: str) -> DataFrame:
    """One reader for all: a path ending in .docx, another path that exists, or else the text itself."""
    jvm = spark._jvm
    fits = len(source) < 1000 and "\n" not in source
    try:
        path = jvm.org.apache.hadoop.fs.Path(source) if fits else None
        found = path is not None and path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    except Exception:  # noqa: BLE001  the text is no path
        found = None
    if not found:
        return spark.createDataFrame([("", source)], "path string, text string")
    if source.lower().endswith(".docx"):
        rows = docx_files(spark, source).filter("error IS NULL")
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("p_idx", "text"))), lambda x: x["text"])
        return rows.groupBy("path").agg(F.array_join(ordered, "\n\n").alias("text"))
    return text_files(spark, source)


def reference_corpus(spark: SparkSession, path: str, most: int = 500, least: int = 50) -> DataFrame:
    """ref, text: the blocks of the files that are separated by lines of three hyphens; of those longer than `least`, the first `most` by file and place, numbered from 0."""
    whole = text_files(spark, path).select("path", F.posexplode(F.split("text", "\n---\n")).alias("pos", "t"))
    rows = whole.select("path", "pos", F.regexp_replace("t", "^\\s+|\\s+$", "").alias("text")).filter(F.length("text") > least)
    first = rows.orderBy("path", "pos").limit(most)
    return first.select((F.row_number().over(Window.orderBy("path", "pos")) - 1).alias("ref"), "text")


# Terms of every discipline.
COMMON_TERMS = ["参考文献", "致谢", "附录", "摘要", "关键词", "Abstract", "Keywords"]


def terms(spark: SparkSession, path: str | None = None) -> DataFrame:
    """term: those of the JSON files at the path, which have them in a list `terms`, and the common ones."""
    common = spark.createDataFrame([(t,) for t in COMMON_TERMS], "term string")
    if path is None:
        return common
    own = spark.read.schema("terms array<string>").option("multiLine", "true").json(path)
    return own.select(F.explode("terms").alias("term")).unionByName(common).distinct()


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, n: of dictionary files with a word, how often it stands in texts and perhaps a class on each line, with spaces between; lines without a number go."""
    parts = F.split(F.regexp_replace("value", "^\\s+|\\s+$", ""), "\\s+")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("word"), F.expr("try_cast(get(split(regexp_replace(value, '^\\\\s+|\\\\s+$', ''), '\\\\s+'), 1) AS bigint)").alias("n")).filter("n IS NOT NULL")


def lexicon(spark: SparkSession, pack) -> DataFrame:
    """lexicon, level, phrase: a pack's expressions as a table."""
    rows = [("connector", level, p) for level, own in pack.connectors.items() for p in own]
    rows += [("slop", level, p) for level, own in pack.slop.items() for p in own] + [("stopword", "", w) for w in pack.stopwords]
    return spark.createDataFrame(rows, "lexicon string, level string, phrase string")

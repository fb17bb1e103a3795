"""Text files as a data source: read in batches and as a stream, and written with a commit.

    files.register(spark)
    spark.read.format("textfiles").load("/texts")                          # path, name, text, n_bytes, error
    spark.readStream.format("textfiles").option("pattern", "*.txt,*.docx").load("/texts")
    reports.write.format("textfiles").mode("append").save("/reports")      # a column text, and perhaps name

Reading: a row for each file, docx or text: of any encoding that readers.decode() knows, or of that which the option encoding names; what a manifest has published is in UTF-8. A file that can't be read costs a row with its error. Partitions are planned by bytes; columns that aren't asked
for aren't made, and without text and error nothing is opened. Filters on path and name leave files out before they are opened.

Writing: each task writes into a folder of its own attempt. A manifest, published when all have ended, names the folders that count; so what failed or repeated attempts leave is never read, and
is removed. With a column name each row is a file, without it a line. Folders that hold manifests are read by them alone.

Files are reached by pyarrow (local and mounted folders, and stores by their address). For stores that only Spark knows, readers.py reads the same texts.
"""

from __future__ import annotations

import fnmatch
import json
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .readers import decode, docx_paragraphs

SCHEMA = "path string, name string, text string, n_bytes long, error string"
#: Bytes of files that a partition has, about; a file is never cut.
PARTITION_BYTES = 64 << 20
#: What opening a file counts, in bytes.
OPEN_BYTES = 64 << 10
#: Rows in a batch, and bytes of text after which one ends.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
MANIFESTS = "_manifests"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return fs.LocalFileSystem(), path


def _name(path: str) -> str:
    base = path.rpartition("/")[2]
    return unquote(base.rpartition(".")[0] if "." in base else base)


@dataclass
class Found:
    path: str
    size: int
    modified: int  # nanoseconds
    published: bool = False  # by a manifest, so in UTF-8


def _manifests(store: fs.FileSystem, root: str) -> list[str]:
    folder = f"{root}/{MANIFESTS}"
    if store.get_file_info(folder).type != fs.FileType.Directory:
        return []
    return sorted(i.path for i in store.get_file_info(fs.FileSelector(folder)) if i.is_file and i.path.endswith(".json"))


def _parts(store: fs.FileSystem, root: str) -> list[dict]:
    """What the manifests of a folder name."""
    out = []
    for m in _manifests(store, root):
        with store.open_input_stream(m) as f:
            out += [p | {"folder": f"{root}/{p['folder']}"} for p in json.loads(f.read())["parts"]]
    return out


def _listed(options: dict) -> list[Found]:
    """The files that the options name, by path. A path may be a file, a folder or a pattern."""
    if "path" not in options:
        raise ValueError("textfiles needs a path")
    store, root = _store(options["path"].rstrip("/"))
    patterns = [p.strip() for p in options.get("pattern", "*").split(",")]
    whole = None
    if any(c in root for c in "*?["):
        whole = root
        at = min(root.index(c) for c in "*?[" if c in root)
        root = root[:at].rpartition("/")[0] or "/"
    info, named = store.get_file_info(root), []
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"{options['path']} does not exist")
    if info.is_file:
        found = [info]
    else:
        named = _parts(store, root) if whole is None else []
        roots = [p["folder"] for p in named] if named else [root]
        found = [i for r in roots for i in store.get_file_info(fs.FileSelector(r, recursive=True)) if i.is_file]
    # what a manifest names counts whatever it is called; of other folders, hidden files and those of Spark's own don't
    kept = [i for i in found if named or i.path == root or not any(s.startswith(("_", ".")) for s in i.path.removeprefix(root).split("/"))]
    if whole:
        kept = [i for i in kept if fnmatch.fnmatchcase(i.path, whole)]
    kept = [i for i in kept if any(fnmatch.fnmatchcase(i.base_name, p) for p in patterns)]
    return sorted((Found(i.path, i.size, int(i.mtime_ns or 0), bool(named)) for i in kept), key=lambda f: f.path)


@dataclass
class Files(InputPartition):
    files: list[Found]


def _planned(found: list[Found], options: dict) -> list[Files]:
    most, out, size = int(options.get("partitionbytes", PARTITION_BYTES)), [], 0
    for f in found:
        own = f.size + OPEN_BYTES
        if not out or size + own > most:
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += own
    return out or [Files([])]


def text_of(content: bytes, path: str, encoding: str) -> str:
    if path.lower().endswith(".docx"):
        return "\n\n".join(t for _, _, t in docx_paragraphs(content))
    return decode(content) if encoding == "auto" else content.decode(encoding)


def _rows(store: fs.FileSystem, files: list[Found], columns: list[str], options: dict) -> Iterator[pa.RecordBatch]:
    kinds = {"path": pa.string(), "name": pa.string(), "text": pa.string(), "n_bytes": pa.int64(), "error": pa.string()}
    opened, rows, size = "text" in columns or "error" in columns, [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in columns], columns)

    for f in files:
        row = {"path": f.path, "name": _name(f.path), "n_bytes": f.size, "text": None, "error": None}
        if opened:
            try:
                with store.open_input_stream(f.path, compression=None) as source:
                    row["text"] = text_of(source.read(), f.path, options.get("encoding", "utf-8" if f.published else "auto"))
            except (OSError, zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                row["error"] = f"{type(e).__name__}: {e}"
        rows.append(row)
        size += len(row["text"] or "")
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options, self.tests = schema.fieldNames(), dict(options), []

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", ())
            if column in (("path",), ("name",)) and isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith):
                self.tests.append(f)
            else:
                yield f

    def _passes(self, found: Found) -> bool:
        for f in self.tests:
            x = found.path if f.attribute == ("path",) else _name(found.path)
            if isinstance(f, EqualTo):
                fits = x == f.value
            elif isinstance(f, In):
                fits = x in f.value
            else:
                fits = x.startswith(f.value) if isinstance(f, StringStartsWith) else x.endswith(f.value)
            if not fits:
                return False
        return True

    def partitions(self):
        return _planned([f for f in _listed(self.options) if self._passes(f)], self.options)

    def read(self, partition: Files):
        yield from _rows(_store(self.options["path"])[0], partition.files, self.columns, self.options)


class _StreamReader(DataSourceStreamReader):
    """An offset is the last file in order of change, then path. Files that changed less than `settle` seconds ago wait, so that others of the same moment are not missed."""

    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options = schema.fieldNames(), dict(options)

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        latest = time.time_ns() - int(float(self.options.get("settle", 1)) * 1e9)
        keys = [(f.modified, f.path) for f in _listed(self.options) if f.modified <= latest]
        modified, path = max(keys, default=(-1, ""))
        return {"modified": modified, "path": path}

    def partitions(self, start: dict, end: dict):
        low, high = ((x["modified"], x["path"]) for x in (start, end))
        return _planned([f for f in _listed(self.options) if low < (f.modified, f.path) <= high], self.options)

    def read(self, partition: Files):
        yield from _rows(_store(self.options["path"])[0], partition.files, self.columns, self.options)


@dataclass
class Part(WriterCommitMessage):
    folder: str
    files: int
    rows: int
    n_bytes: int


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        names = schema.fieldNames()
        if "text" not in names or set(names) - {"name", "text"}:
            raise ValueError("textfiles writes a column text, and perhaps name")
        if "path" not in options:
            raise ValueError("textfiles needs a path")
        self.named, self.root, self.overwrite = "name" in names, options["path"].rstrip("/"), overwrite
        self.extension, self.job = options.get("extension", ".txt"), uuid.uuid4().hex

    def write(self, rows) -> Part:
        store, root = _store(self.root)
        task = TaskContext.get()
        part = Part(f"{self.job}/{task.partitionId():05d}-{task.taskAttemptId()}", 0, 0, 0)
        folder, used, out = f"{root}/{part.folder}", set(), None
        try:
            for r in rows:
                data = (r["text"] or "").encode()
                if part.rows == 0:
                    store.create_dir(folder, recursive=True)
                if self.named:
                    base, k = quote(str(r["name"] if r["name"] is not None else ""), safe=" "), 0
                    while (name := base + (f"~{k}" if k else "")) in used:
                        k += 1
                    used.add(name)
                    with store.open_output_stream(f"{folder}/{name}{self.extension}", compression=None) as f:
                        f.write(data)
                    part.files += 1
                else:
                    if out is None:
                        out = store.open_output_stream(f"{folder}/part{self.extension}", compression=None)
                        part.files = 1
                    out.write(data.replace(b"\n", b" ") + b"\n")
                part.rows += 1
                part.n_bytes += len(data)
        finally:
            if out is not None:
                out.close()
        return part

    def commit(self, messages) -> None:
        store, root = _store(self.root)
        parts = [m for m in messages if m is not None and m.rows]
        before = _manifests(store, root)
        self._clear(store, root, {m.folder for m in parts})
        store.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        manifest = {"job": self.job, "rows": sum(m.rows for m in parts), "files": sum(m.files for m in parts), "n_bytes": sum(m.n_bytes for m in parts), "parts": [vars(m) for m in parts]}
        waiting = f"{root}/{MANIFESTS}/{self.job}.waiting"
        with store.open_output_stream(waiting, compression=None) as f:
            f.write(json.dumps(manifest).encode())
        store.move(waiting, f"{root}/{MANIFESTS}/{self.job}.json")
        for m in before if self.overwrite else ():
            job = m.rpartition("/")[2].removesuffix(".json")
            store.delete_file(m)
            if store.get_file_info(f"{root}/{job}").type == fs.FileType.Directory:
                store.delete_dir(f"{root}/{job}")

    def abort(self, messages) -> None:
        store, root = _store(self.root)
        self._clear(store, root, set())

    def _clear(self, store: fs.FileSystem, root: str, keep: set[str]) -> None:
        """Remove what attempts that don't count have left."""
        own = f"{root}/{self.job}"
        if store.get_file_info(own).type != fs.FileType.Directory:
            return
        for i in store.get_file_info(fs.FileSelector(own)):
            if f"{self.job}/{i.base_name}" not in keep:
                store.delete_dir(i.path)
        if not keep:
            store.delete_dir(own)


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TextFiles)


def manifest(path: str) -> list[dict]:
    """What has been published in a folder: a dictionary for each write."""
    store, root = _store(path.rstrip("/"))
    out = []
    for m in _manifests(store, root):
        with store.open_input_stream(m) as f:
            out.append(json.loads(f.read()))
    return out


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of what has been published without names, read by Spark itself."""
    store, root = _store(path.rstrip("/"))
    folders = [("file://" if isinstance(store, fs.LocalFileSystem) else "") + p["folder"] for p in _parts(store, root)]
    return spark.read.text(folders) if folders else spark.createDataFrame([], "value string")

"""Benchmark passages in documents by Wu-Manber search over words.

Test strings are the windows of ten words of every benchmark item (or the whole
of a shorter item). For test strings of one length, a table by the hash of a block of two words tells
how far a search may move on when such a block ends the words under view; blocks
that no test string has allow the longest move. Where the move is zero, the hash
of the last block selects a bucket of test strings, and those of it that begin with the block that stands there are compared word by word.
All texts of a batch are searched at once, each stretch with a cursor of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import slices, small_batches, text_bytes, unwrite, written
from ._words import LOWER, NOT_ALNUM, Words, draw, windows, windows_at

#: Words in a window.
WINDOW = 10
#: Words in a block of the shift tables.
BLOCK = 2
#: Entries of a shift table, as a power of two.
BITS = 20
#: Words that one cursor searches.
STRETCH = 512
#: Places whose test strings are compared at once.
CANDIDATES = 4096
#: Bytes of benchmark text in one set of tables. Beyond, items are dealt into more sets, and the documents searched for one after another.
SET_BYTES = 32 << 20


def _words(texts: list[str | None], place: int) -> tuple[Words, np.ndarray]:
    raw, at = text_bytes(pa.array(texts, pa.string()))
    raw = LOWER[raw]
    return Words(raw, at, NOT_ALNUM, place), raw


def joined(raw: np.ndarray, words: Words, first: int, n: int) -> bytes:
    return b" ".join(raw[s:e].tobytes() for s, e in zip(words.starts[first : first + n].tolist(), words.ends[first : first + n].tolist()))


class Tables:
    """Test strings of one length: shift table, and buckets of test strings by the hash of their last block of words, in each by that of their first block.

    first: the first word of each test string among the benchmark's words; item: the number of its item; text: all words with one space between, and
    begin: where each begins there.
    """

    def __init__(self, length: int, words: Words, text: bytes, begin: np.ndarray, first: np.ndarray, item: np.ndarray):
        self.length, self.block = length, min(BLOCK, length)
        self.reach = length - self.block + 1
        self.shift = np.full(1 << BITS, self.reach, np.uint8 if self.reach < 256 else np.uint16)
        blocks = windows(words.hash, self.block)
        for j in range(self.reach):
            self.shift[blocks[first + j] >> np.uint64(64 - BITS)] = self.reach - 1 - j
        self.hash, self.text, self.edge = words.hash, text, begin
        # equal test strings are one, with a list of items
        one, group = self._distinct(windows_at(words.hash, first, length), first)
        order = np.lexsort((blocks[first[one]], blocks[first[one] + length - self.block]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.first, group = first[one][order], rank[group]
        self.suffixes, bucket = np.unique(blocks[self.first + length - self.block], return_inverse=True)
        self.places = self._place(bucket, blocks[self.first])
        order = np.lexsort((item, group))
        new = np.ones(len(order), bool)
        new[1:] = (group[order][1:] != group[order][:-1]) | (item[order][1:] != item[order][:-1])
        self.items = item[order][new]
        self.at = np.searchsorted(group[order][new], np.arange(len(self.first) + 1))

    def _distinct(self, keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of each group of equal test strings, and the group of each. Hashes bring them together; what then differs stays apart."""
        _, one, group = np.unique(keys, return_index=True, return_inverse=True)
        own = one.tolist()
        for k in np.setdiff1d(np.arange(len(first)), one).tolist():
            if self._string(first[k]) != self._string(first[own[group[k]]]):
                group[k] = len(own)
                own.append(k)
        return np.array(own, np.int64), group

    @staticmethod
    def _place(bucket: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """A number by which test strings are in order: their bucket, then their first block."""
        return (bucket.astype(np.uint64) << np.uint64(32)) | (prefix >> np.uint64(32))

    def _string(self, first: int) -> bytes:
        return self.text[self.edge[first] : self.edge[first + self.length] - 1]

    def string(self, k: int) -> bytes:
        return self._string(self.first[k])

    def compared(self, words: Words, raw: np.ndarray, begin: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words from each place against all test strings of the bucket that the last block selects and that begin with its first block: places and test strings that are the same, word by word."""
        suffix = blocks[begin + self.length - self.block]
        bucket = np.minimum(np.searchsorted(self.suffixes, suffix), len(self.suffixes) - 1)
        begin, bucket = begin[there := self.suffixes[bucket] == suffix], bucket[there]
        own = self._place(bucket, blocks[begin])
        low, high = np.searchsorted(self.places, own, "left"), np.searchsorted(self.places, own, "right")
        found = []
        for i in range(0, len(begin), CANDIDATES):
            j, n = slice(i, i + CANDIDATES), (high - low)[i : i + CANDIDATES]
            at = np.repeat(begin[j], n)
            k = np.repeat(low[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            for w in range(self.length):
                same = self.hash[self.first[k] + w] == words.hash[at + w]
                at, k = at[same], k[same]
            same = np.array([joined(raw, words, a, self.length) == self.string(x) for a, x in zip(at.tolist(), k.tolist(), strict=True)], bool)
            found.append((at[same], k[same]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *(x[c] for x in found)]) for c in (0, 1))


def compile_tables(texts: list[str | None], items: list[int], window: int = WINDOW) -> tuple[int, list[Tables]]:
    """items: the number of each text's item. Words are hashed at a place drawn for this run, so that no texts can be made for which buckets are full."""
    place = draw()
    words, raw = _words(texts, place)
    size = np.minimum(words.counts(), window)
    text = joined(raw, words, 0, len(words.hash))
    begin = np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)])
    out = []
    for n in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == n)
        many = words.counts()[own] - n + 1
        first = np.repeat(words.at[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out.append(Tables(n, words, text, begin, first, np.repeat(np.array(items, np.int64)[own], many)))
    return place, out


def search(words: Words, raw: np.ndarray, table: Tables) -> tuple[np.ndarray, np.ndarray]:
    """First words of all occurrences, in one text each, and which test string each is."""
    m, n = table.length, len(words.hash)
    none = np.zeros(0, np.int64)
    if n < m:
        return none, none
    # a stretch: the window ends that one cursor visits, in one text
    first, last = words.at[:-1] + m - 1, words.at[1:]
    count = np.maximum(-(-(last - first) // STRETCH), 0)
    owner = np.repeat(np.arange(len(count)), count)
    begin = first[owner] + (np.arange(count.sum()) - (np.cumsum(count) - count)[owner]) * STRETCH
    stop = np.minimum(begin + STRETCH, last[owner])
    blocks = windows(words.hash, table.block)
    shift = table.shift[blocks >> np.uint64(64 - BITS)]  # by the block's first word
    hits, cursor = [], begin
    while len(cursor):
        step = shift[cursor - table.block + 1].astype(np.int64)
        zero = step == 0
        if zero.any():
            hits.append(cursor[zero])
            step[zero] = 1
        cursor = cursor + step
        go = cursor < stop
        cursor, stop = cursor[go], stop[go]
    if not hits:
        return none, none
    return table.compared(words, raw, np.sort(np.concatenate(hits)) - m + 1, blocks)


def _sets(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator:
    """How many sets there are; then each as broadcast tables of bounded size, with the names of items."""
    spark = benchmark.sparkSession
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-total // most))
    yield parts
    for k in range(parts):
        names: dict[str | None, int] = {}
        texts, items = [], []
        for r in rows.filter(F.pmod(F.xxhash64("text", "item"), F.lit(parts)) == k).toLocalIterator():
            texts.append(r.text)
            items.append(names.setdefault(r.item, len(names)))
        yield spark.sparkContext.broadcast((*compile_tables(texts, items, window), [x or "" for x in names]))


def _occurrences(shared, words: Words, raw: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
    """How often each word begins and ends being covered, added up, and the names of items in each text."""
    _, tables, names = shared.value
    edge = np.zeros(len(words.hash) + 1, np.int64)
    items: list[set] = [set() for _ in words.at[1:]]
    for table in tables:
        begin, at = search(words, raw, table)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + table.length, -1)
        owner = np.searchsorted(words.at, begin, "right") - 1
        for d, k in {*zip(owner.tolist(), at.tolist())}:
            items[d].update(names[x] for x in table.items[table.at[k] : table.at[k + 1]].tolist())
    return np.cumsum(edge[:-1]) > 0, [sorted(x) for x in items]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    set_bytes: int = SET_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Words are runs of characters other than ASCII ones that are no letter or digit, with A-Z lower-cased. A word
    is hit when any occurrence of a test string covers it. A null or empty text has no words and no items; items without words
    are never found; an item that occurs in several rows counts once by its id (a null id is named ''). Rows that repeat an id get a row each. An
    empty table of documents gives no rows, an empty benchmark no hits.
    """
    small_batches(docs.sparkSession)
    sets = _sets(benchmark, item_col, item_text_col, window, set_bytes)
    parts = next(sets)
    # what several sets find is brought together by id and text
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) if parts > 1 else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), key.alias("tk"))

    def found(shared, every: bool):
        """Of each document (or each that has an item) id, key of the text, words, hit words, their places, items."""

        def run(batches):
            for batch in batches:
                raw_all, at_all = text_bytes(batch.column(1))
                for i, j in slices(at_all):
                    raw = LOWER[raw_all[at_all[i] : at_all[j]]]
                    words = Words(raw, at_all[i : j + 1] - at_all[i], NOT_ALNUM, shared.value[0])
                    covered, lists = _occurrences(shared, words, raw)
                    hits = np.diff(np.concatenate([[0], np.cumsum(covered)])[words.at])
                    columns = [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(words.counts(), pa.int64()), pa.array(hits, pa.int64())]
                    if not every:
                        place = np.flatnonzero(covered)
                        place -= words.at[np.searchsorted(words.at, place, "right") - 1]
                        columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(hits)]).astype(np.int32), pa.array(place.astype(np.int32))))
                    out = pa.RecordBatch.from_arrays([*columns, pa.array(lists, pa.list_(pa.string()))], names)
                    yield out if every else out.filter(pa.array(hits > 0))

        names = ["id", "tk", "n_words", "n_hit", *([] if every else ["places"]), "items"]
        kinds = {"places": "array<int>", "items": "array<string>", "tk": "string"}
        return base.select("id", "text", "tk").mapInArrow(run, ", ".join(f"{x} {kinds.get(x, 'long')}" for x in names))

    if parts == 1:
        out = found(next(sets), True)
    else:
        # one set after another, so that no more than one is in memory
        some = []
        for shared in sets:
            some.append(written(found(shared, False), "hits"))
            shared.destroy()
        all_of = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
        hits = reduce(DataFrame.unionByName, some)
        hits = hits.groupBy("id", "tk").agg(F.size(all_of("places")).cast("long").alias("n_hit"), F.sort_array(all_of("items")).alias("items"))
        hits = written(hits.withColumnsRenamed({"id": "i", "tk": "k"}), "hits")
        unwrite(*some)

        def count(batches):
            for batch in batches:
                raw, at = text_bytes(batch.column(1))
                n = [x for i, j in slices(at) for x in Words(LOWER[raw[at[i] : at[j]]], at[i : j + 1] - at[i], NOT_ALNUM, None).counts().tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "tk", "n_words"])

        counted = base.mapInArrow(count, "id long, tk string, n_words long")
        out = counted.join(hits, F.col("id").eqNullSafe(F.col("i")) & (F.col("tk") == F.col("k")), "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def uncontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, set_bytes: int = SET_BYTES
) -> DataFrame:
    """The rows without any test string in their text, with all their columns. Each row is judged by itself, whatever its id; the rows pass the search and are not joined with its verdicts.

    Of several sets of test strings each is searched for in what the one before has left.
    """
    small_batches(docs.sparkSession)
    sets = _sets(benchmark, item_col, item_text_col, window, set_bytes)
    parts, place = next(sets), docs.columns.index(text_col)
    for k, shared in enumerate(sets):

        def run(batches, shared=shared):
            for batch in batches:
                raw_all, at_all = text_bytes(batch.column(place))
                for i, j in slices(at_all):
                    raw = LOWER[raw_all[at_all[i] : at_all[j]]]
                    words = Words(raw, at_all[i : j + 1] - at_all[i], NOT_ALNUM, shared.value[0])
                    hit = np.zeros(j - i, bool)
                    for table in shared.value[1]:
                        hit[np.searchsorted(words.at, search(words, raw, table)[0], "right") - 1] = True
                    yield batch.slice(i, j - i).filter(pa.array(~hit))

        docs = docs.mapInArrow(run, docs.schema)
        if k + 1 < parts:
            # so that no more than one set is in memory
            docs = written(docs, "clean")
            shared.destroy()
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES = {
    "op10_decontaminate": r"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT item, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0),
pat AS (
  SELECT DISTINCT item, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
  FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bs)),
sizes AS (SELECT DISTINCT m FROM bs),
win AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
hit AS (SELECT win.doc_id, win.i, win.m, pat.item FROM win JOIN pat ON win.s = pat.s AND win.m = pat.m),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
}

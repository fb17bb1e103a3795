"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is 13 consecutive words of one document. Every window has an anchor, the four words in it of the
smallest hash; equal windows have equal anchors. So only stretches around anchors that stand in several texts can
repeat, a stretch being the run of windows with one occurrence of an anchor; and whole texts of which there are copies. The words of all these
are dealt by anchor (or by text) into shards. There, passages that recur are confirmed on their words: a stretch that is the same in all its
documents, or the windows that stretches of one anchor share. They are compiled into automata, and
all stretches of all documents stream through those; each place where a passage occurs is found, with the smallest document known to have it.

Hashes only bring candidates together; what goes, goes because its words were found. Anchors with very many stretches are dealt into cells by document.
A cell then hands on the first place of each of its windows, and these meet in a second round, window by window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._filters import Filter, Levels
from ._shared import slices, small_batches, text_bytes, unwrite, written
from ._words import WHITE, Words, draw, mix, windows, within

#: Words in a window.
WINDOW = 13
#: Words in an anchor.
ANCHOR = 4
#: Bits of the filter of repeated anchors at most; with more anchors than fit, a join takes its place.
FILTER_BITS = 32
#: Stretches of one anchor, or copies of a text (or kilobytes of them), in a cell.
SPREAD = 2_000
#: Stretches that share automata, about: groups are kept whole.
SHARD = 40_000
#: Characters of the stretches that share automata, about.
SHARD_CHARS = 16 << 20

_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[WHITE] = 32
_FOUND = "id long, tk long, start int, n int, starts array<int>, text string, whole boolean"
_ROWS = "key long, cell long, hot boolean, id long, tk long, starts array<int>, whole boolean, text string"
_ROW_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch: the anchor's hash, the text it is in, its first word and its number of windows."""
    first, owner = within(words.at, window)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    marks = windows(words.hash, anchor)
    n = len(words.hash) - window + 1
    best, off = marks[:n].copy(), np.zeros(n, np.uint8)
    for j in range(1, window - anchor + 1):
        less = marks[j : j + n] < best
        np.copyto(best, marks[j : j + n], where=less)
        off[less] = j
    best, place = best[first], first + off[first]
    new = np.ones(len(first), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    return best[begin], owner[begin], first[begin], np.diff(np.append(begin, len(first)))


def run_texts(raw: np.ndarray, words: Words, first: np.ndarray, n: np.ndarray) -> list[str]:
    """The texts of runs of n words each (at least one), with one space between words."""
    plain = _SPACES[raw].tobytes()
    wide = np.concatenate([[0], np.cumsum(words.starts[1:] - words.ends[:-1] != 1)]) if len(words.starts) else np.zeros(1, int)
    last = first + n - 1
    even = wide[last] == wide[first]
    out = [plain[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[first].tolist(), words.ends[last].tolist())]
    for k in np.flatnonzero(~even).tolist():
        out[k] = " ".join(x for x in out[k].split(" ") if x)
    return out


class Letters(dict):
    """Two letters for each word, so that passages are short strings and no node of their automaton has many children. First and second letters differ."""

    def __missing__(self, word: str) -> str:
        n = len(self)
        self[word] = out = chr(257 + n // 256) + chr(1 + n % 256)
        return out

    def spell(self, text: str) -> str:
        return "".join(map(self.__getitem__, text.split(" ")))


def locate(group: np.ndarray, hot: np.ndarray, ids: np.ndarray, whole: np.ndarray, texts: pa.Array, window: int) -> tuple:
    """Places of passages in rows of whole groups: row, first word and words of each, and what the second round has to see.

    Of each group, passages are the text of its rows, if they all have the same one in several documents, or else the
    windows that several documents have. A place counts if a smaller document has the passage. For rows of hot groups, the second round gets
    the first place of each window, or the first row of each whole text: row, first word, words.
    """
    import ahocorasick

    coded = texts.dictionary_encode()
    code, values = np.asarray(coded.indices), coded.dictionary.to_pylist()
    order = np.lexsort((ids, code, group))
    g, c, d = group[order], code[order], ids[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    begin = np.flatnonzero(new)
    after = np.append(begin[1:], len(g))
    first, last, ends = d[begin], d[after - 1], dict(zip(begin.tolist(), after.tolist()))
    kinds = np.unique(g[begin], return_counts=True)[1]
    alone = np.repeat(kinds == 1, kinds)
    letters, spelt = Letters(), [None] * len(values)
    passages: dict[str, int] = {}
    seen: dict[str, list] = {}
    second: list[tuple[int, int, int]] = []
    for v, lo, hi, one, at in zip(c[begin].tolist(), first.tolist(), last.tolist(), alone.tolist(), begin.tolist()):
        row, rows = order[at], ()
        if spelt[v] is None:
            spelt[v] = letters.spell(values[v])
        text = spelt[v]
        if one and lo < hi:
            passages[text] = min(lo, passages.get(text, lo))
        if hot[row] and whole[row]:
            second.append((row, 0, len(text) // 2))
        if one and (whole[row] or not hot[row]):
            continue
        if hot[row] and not whole[row]:
            # all places in the smallest document
            rows = order[at : at + int(np.searchsorted(d[at:ends[at]], lo, "right"))].tolist()
        for k in range(len(text) // 2 - window + 1):
            w = text[2 * k : 2 * (k + window)]
            known = seen.get(w)
            if known is None:
                seen[w] = [lo, hi, [(r, k, window) for r in rows]]
                continue
            if lo < known[0]:
                known[0], known[2] = lo, [(r, k, window) for r in rows]
            elif lo == known[0]:
                known[2] += [(r, k, window) for r in rows]
            if hi > known[1]:
                known[1] = hi
    for w, (lo, hi, places) in seen.items():
        if lo < hi:
            passages[w] = min(lo, passages.get(w, lo))
        second += places
    none = np.zeros(0, np.int64)
    if not passages:
        return none, none, none, second
    automaton = ahocorasick.Automaton()
    for text, lo in passages.items():
        automaton.add_word(text, (len(text) // 2, lo))
    automaton.make_automaton()
    # every text streams through; neighbouring windows of one document are one place
    counts, found = np.zeros(len(values), np.int64), []
    for v, text in enumerate(spelt):
        open_: dict[int, list] = {}
        before = len(found)
        for end, (n, lo) in automaton.iter(text):
            end //= 2
            run = open_.get(lo)
            if run is not None and run[1] >= end - n and run[0] <= end - n + 1:
                run[1] = end
            else:
                open_[lo] = run = [end - n + 1, end, lo]
                found.append(run)
        counts[v] = len(found) - before
    if not found:
        return none, none, none, second
    place = np.array(found, np.int64)
    start = np.cumsum(counts) - counts
    many = counts[code]
    rows = np.repeat(np.arange(len(code)), many)
    hit = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[code], many)
    use = place[hit, 2] < ids[rows]
    rows, hit = rows[use], hit[use]
    return rows, place[hit, 0], place[hit, 1] - place[hit, 0] + 1, second


def _located(rows: DataFrame, window: int, shard: int) -> DataFrame:
    """The places found in the rows, and (with their text) the rows of the second round."""

    def settle(table: pa.Table, edge: np.ndarray):
        col = {x: np.asarray(table.column(x).combine_chunks()) for x in ("hot", "id", "tk", "whole")}
        texts, starts = table.column("text").combine_chunks(), table.column("starts").combine_chunks()
        many, values = np.asarray(starts.value_lengths()).astype(np.int64), np.asarray(starts.flatten()).astype(np.int64)
        begin = np.cumsum(many) - many
        at, off, n, second = locate(np.cumsum(edge), col["hot"], col["id"], col["whole"], texts, window)
        # a place of a stretch is one wherever its document has the stretch
        each, to = _spread(begin[at], many[at])
        at = at[each]
        found = [pa.array(col["id"][at]), pa.array(col["tk"][at]), pa.array((values[to] + off[each]).astype(np.int32)), pa.array(n[each].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*found, *(pa.nulls(len(at), t) for t in (pa.list_(pa.int32()), pa.string(), pa.bool_()))], names)
        if second:
            row, k, n = (np.array(x) for x in zip(*second))
            own = texts.take(pa.array(row)).to_pylist()
            own = [t if whole else " ".join(t.split(" ")[a : a + b]) for t, whole, a, b in zip(own, col["whole"][row], k.tolist(), n.tolist())]
            each, to = _spread(begin[row], many[row])
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(many[row])).astype(np.int32), pa.array((values[to] + k[each]).astype(np.int32)))
            found = [pa.array(col["id"][row]), pa.array(col["tk"][row]), *(pa.nulls(len(row), pa.int32()) for _ in "sn")]
            yield pa.RecordBatch.from_arrays([*found, lists, pa.array(own, pa.string()), pa.array(col["whole"][row])], names)

    def run(batches):
        held, size, chars = [], 0, 0
        for batch in batches:
            held.append(batch)
            size, chars = size + batch.num_rows, chars + batch.column(7).nbytes
            if size < shard and chars < SHARD_CHARS:
                continue
            table = pa.Table.from_batches(held)
            edge = _edges(table)
            cut = int(np.flatnonzero(edge)[-1])
            if cut:
                yield from settle(table.slice(0, cut), edge[:cut])
                held = table.slice(cut).combine_chunks().to_batches()
                size, chars = len(table) - cut, sum(b.column(7).nbytes for b in held)
        if size:
            table = pa.Table.from_batches(held)
            yield from settle(table, _edges(table))

    names = [x.split()[0] for x in _FOUND.split(", ")]
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(run, _FOUND)


def _spread(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of n numbers from `begin` on: which run each number is of, and the numbers."""
    each = np.repeat(np.arange(len(n)), n)
    return each, np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + begin[each]


def _edges(table: pa.Table) -> np.ndarray:
    """Where a group begins."""
    key, cell = (np.asarray(table.column(x).combine_chunks()) for x in ("key", "cell"))
    out = np.ones(len(key), bool)
    out[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, filter_bits: int = FILTER_BITS, shard: int = SHARD, spread: int = SPREAD) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text.

    Words are runs without white space. A word goes if any window over it is, as a word sequence, also in a document with a
    smaller id; all windows are judged on the input. kept_text has the other words, joined by one space. A null id counts as larger than any; documents of the
    same id never remove each other's words. Null and empty texts have no words; texts of fewer words than a window lose none. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text).alias("tk"))
    key = draw()

    def parts(batches):
        """Per part of a batch: keys of texts, ids, bytes, words, anchors."""
        for batch in batches:
            raw, at = text_bytes(batch.column(0))
            ids, tks = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for i, j in slices(at):
                own = raw[at[i] : at[j]]
                words = Words(own, at[i : j + 1] - at[i], WHITE, key)
                yield tks[i:j], ids[i:j], own, words, anchors(words, window, anchor)

    def mark(batches):
        for tks, _, _, _, (fp, owner, _, _) in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(tks[owner])], ["fp", "tk"])

    def repeated(df: DataFrame, by: str, other: str, n) -> DataFrame:
        found = df.groupBy(by).agg(F.min(other).alias("lo"), F.max(other).alias("hi"), n.alias("n"))
        return found.filter("lo < hi").select(F.col(by).alias("key"), "n")

    marks = written(repeated(base.mapInArrow(mark, "fp long, tk long"), "fp", "tk", F.count(F.lit(1))), "anchors")
    copies = written(repeated(base.select("id", "tk", F.octet_length("text").alias("size")), "tk", "id", F.sum(F.greatest(F.lit(1), F.shiftright("size", 10)))), "copies")
    fit = [Filter.fits(x, filter_bits) for x in (marks, copies)]
    filters = [Filter(x, filter_bits) if on else None for x, on in zip((marks, copies), fit)]
    cells = [Levels(x, spread, filter_bits) for x in (marks, copies)]
    shared = spark.sparkContext.broadcast((filters, cells))

    def emitted(raw, words, first, n, keys, cell, of, ids, tks, start, whole) -> pa.RecordBatch:
        """A row for each text of each document, with the places where it begins there."""
        texts = pa.array(run_texts(raw, words, first, n), pa.string())
        code = np.asarray(texts.dictionary_encode().indices)
        order = np.lexsort((start, code, of))
        new = np.ones(len(order), bool)
        new[1:] = (of[order][1:] != of[order][:-1]) | (code[order][1:] != code[order][:-1])
        one, begin = order[new], np.append(np.flatnonzero(new), len(order))
        lists = pa.ListArray.from_arrays(begin.astype(np.int32), pa.array(start[order].astype(np.int32)))
        cells = (mix(ids.view(np.uint64)) % cell.astype(np.uint64)).astype(np.int64)
        columns = [pa.array(x[one]) for x in (keys.view(np.int64), cells, cell > 1, ids, tks)]
        return pa.RecordBatch.from_arrays([*columns, lists, pa.array(np.full(len(one), whole)), texts.take(pa.array(one))], _ROW_NAMES)

    def stretches(batches):
        filters, cells = shared.value
        for tks, ids, raw, words, (fp, owner, first, n) in parts(batches):
            use = filters[0].passing(fp)
            if len(use):
                own = owner[use]
                yield emitted(raw, words, first[use], n[use] + window - 1, fp[use], cells[0].of(fp[use]), own, ids[own], tks[own], first[use] - words.at[own], False)
            use = filters[1].passing(tks.view(np.uint64))
            use = use[words.counts()[use] >= window]
            if len(use):
                yield emitted(raw, words, words.at[use], words.counts()[use], tks[use], cells[1].of(tks[use].view(np.uint64)), use, ids[use], tks[use], np.zeros(len(use)), True)

    def all_places(batches):
        for tks, ids, _, words, (fp, owner, first, n) in parts(batches):
            counts = words.counts()
            long = np.flatnonzero(counts >= window)
            columns = [np.concatenate([fp.view(np.int64), tks[long]]), np.concatenate([ids[owner], ids[long]]), np.concatenate([tks[owner], tks[long]])]
            columns += [np.concatenate([first - words.at[owner], np.zeros(len(long), np.int64)]).astype(np.int32), np.concatenate([n + window - 1, counts[long]]).astype(np.int32), np.arange(len(fp) + len(long)) >= len(fp)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "id", "tk", "start", "n", "whole"])

    def cut_out(batches):
        for batch in batches:
            raw, at = text_bytes(batch.column(0))
            for i, j in slices(at):
                own = raw[at[i] : at[j]]
                words = Words(own, at[i : j + 1] - at[i], WHITE, None)
                ids, tks = (np.asarray(batch.column(k).slice(i, j - i)) for k in (1, 2))
                for whole in (False, True):
                    runs = [(k, x) for k, own_runs in enumerate(batch.column(3).slice(i, j - i).to_pylist()) for x in own_runs if x["whole"] == whole]
                    if runs:
                        of = np.array([k for k, _ in runs])
                        column = {x: np.array([r[x] for _, r in runs], np.int64) for x in ("key", "start", "n", "cell")}
                        yield emitted(own, words, words.at[of] + column["start"], column["n"], column["key"], column["cell"], of, ids[of], tks[of], column["start"], whole)

    if all(fit):
        rows = base.mapInArrow(stretches, _ROWS)
    else:
        # too many for filters: join on the keys alone, and bring the places to the texts
        both = marks.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("whole", F.lit(True)))
        cell = F.greatest(F.lit(1), F.ceil(F.col("count") / spread)).cast("long").alias("cell")
        places = base.mapInArrow(all_places, "key long, id long, tk long, start int, n int, whole boolean")
        salted = F.xxhash64("key", "whole").alias("salt")
        places = places.select("*", salted).join(both.withColumnRenamed("n", "count").select("*", salted), ["salt", "key", "whole"])
        runs = places.groupBy("id", "tk").agg(F.collect_set(F.struct("key", "start", "n", "whole", cell)).alias("runs"))
        rows = base.join(runs, ["id", "tk"]).select("text", "id", "tk", "runs").mapInArrow(cut_out, _ROWS)

    one = written(_located(rows, window, shard), "places")
    again = one.filter("text IS NOT NULL").select(F.xxhash64("text").alias("key"), F.lit(0).cast("long").alias("cell"), F.lit(False).alias("hot"), "id", "tk", "starts", "whole", "text")
    two = _located(again, window, shard)
    spans = one.filter("text IS NULL").unionByName(two).select("id", "tk", F.struct(F.col("start").alias("s"), "n").alias("span"))
    spans = written(spans.groupBy("id", "tk").agg(F.collect_set("span").alias("spans")), "spans")
    unwrite(one, marks, copies)

    def cut(batches):
        for batch in batches:
            raw_all, at = text_bytes(batch.column(0))
            for i, j in slices(at):
                raw = raw_all[at[i] : at[j]]
                words = Words(raw, at[i : j + 1] - at[i], WHITE, None)
                keep = np.ones(len(words.starts) + 1, bool)
                lists = batch.column(2).slice(i, j - i)
                flat = lists.flatten()
                if len(flat):
                    of = np.repeat(np.arange(j - i), np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0))).astype(int))
                    a = words.at[of] + np.asarray(flat.field("s"))
                    edge = np.zeros(len(keep) + 1, np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, a + np.asarray(flat.field("n")), -1)
                    keep = np.cumsum(edge[:-1]) <= 0
                keep[-1] = False
                # runs of kept words, none over the end of a text
                begin = keep.copy()
                begin[1:] &= ~keep[:-1]
                begin[words.at[:-1]] = keep[words.at[:-1]]
                begin = np.flatnonzero(begin)
                total = np.concatenate([[0], np.cumsum(keep)])
                size = np.diff(np.append(total[begin], total[-1]))
                runs, cuts = run_texts(raw, words, begin, size), np.searchsorted(begin, words.at)
                kept = [" ".join(runs[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                gone = words.counts() - np.diff(total[words.at])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(words.counts()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    tagged = base.join(spans.hint("shuffle_hash"), ["id", "tk"], "left").select("text", "id", "spans")
    out = tagged.mapInArrow(cut, "id long, n_words long, n_removed long, kept_text string")
    return out.select(F.expr(f"nullif(id, {(1 << 63) - 1})").alias(id_col), "n_words", "n_removed", "kept_text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES = {
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS lo FROM v GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k
  FROM (SELECT v.doc_id, v.i FROM v JOIN f ON v.s = f.s WHERE f.lo < v.doc_id)),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS s, count(*) AS n
  FROM t LEFT JOIN gone USING (doc_id, k) WHERE gone.k IS NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
}

"""Main text of HTML pages by a recurrent labeller of blocks.

A page is a sequence of leaf blocks. Each becomes a vector: hashed names on its path of elements, hashed words, and some
measures. A bidirectional LSTM reads the whole sequence, so that every block is judged by all
that stands before and after it. Training and use are numpy only; it learns from made-up pages, whose blocks' labels are known.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pages import blocks, labelled
from ._shared import small_batches

PATHS, WORDS, MEASURES = 128, 48, 10
SIZE = PATHS + WORDS + MEASURES
HIDDEN = 24
#: Made-up pages, passes over them and pages in a step.
PAGES, PASSES, STEP = 1500, 8, 16
#: Blocks that are labelled together. A page of more is read stretch by stretch, with the state handed on.
TOGETHER = 4096

_WORD = re.compile(r"\w+|[^\w\s]")
_places: dict[str, int] = {}
_paths: dict[tuple, np.ndarray] = {}


def _place(token: str, n: int) -> int:
    key = f"{n} {token}"
    if key not in _places:
        if len(_places) > 200_000:
            _places.clear()
        _places[key] = zlib.crc32(key.encode("utf-8", "replace")) % n
    return _places[key]


def features(found: list, begin: int = 0, end: int | None = None) -> np.ndarray:
    """[blocks, SIZE] of a stretch of a page's blocks."""
    x = np.zeros((len(found[begin:end]), SIZE), np.float32)
    for k, (path, text, links) in enumerate(found[begin:end]):
        where = _paths.get(path)
        if where is None:
            if len(_paths) > 20_000:
                _paths.clear()
            where = _paths[path] = np.unique([_place(t, PATHS) for t in path]) if path else np.zeros(0, int)
        x[k, where] = 1
        words = _WORD.findall(text.lower())
        n = max(len(words), 1)
        spots = np.bincount([_place(w, WORDS) for w in words], minlength=WORDS)
        x[k, PATHS : PATHS + WORDS] = np.minimum(spots * (3 / n), 1)
        stops = sum(text.count(c) for c in ".!?")
        x[k, PATHS + WORDS :] = (
            np.log1p(n) / 4, np.log1p(len(text)) / 6, links / len(text), n < 4, n > 25, stops / n * 2,
            text[-1] in ".!?", text[:1].isupper(), (begin + k + 1) / (len(found) + 1), len(path) / 10,
        )
    return x


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """One LSTM layer each way and a logistic output. Sequences are [time, pages, SIZE], with a mask [time, pages]."""

    def __init__(self, seed: int = 11, size: int = SIZE, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        make = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w |= {f"x{d}": make(size, 4 * hidden), f"h{d}": make(hidden, 4 * hidden), f"b{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)}
        self.w |= {"o": make(2 * hidden, 1), "c": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: tuple | None = None):
        t, b, _ = x.shape
        n = self.hidden
        zx = (x.reshape(t * b, -1) @ self.w[f"x{d}"] + self.w[f"b{d}"]).reshape(t, b, 4 * n)
        h, c = state or (np.zeros((b, n), np.float32), np.zeros((b, n), np.float32))
        out, trace = np.zeros((t, b, n), np.float32), {}
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = zx[k] + h @ self.w[f"h{d}"]
            i, f, o = _sig(z[:, :n]), _sig(z[:, n : 2 * n]), _sig(z[:, 2 * n : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            m = mask[k][:, None]
            before, c = (h, c), (f * c + i * g) * m
            th = np.tanh(c)
            h = o * th * m
            out[k] = h
            if keep:
                trace[k] = (*before, i, f, o, g, th, m)
        return out, trace, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        runs = {d: self._run(x, mask, d, keep) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        return _sig((both @ self.w["o"])[:, :, 0] + self.w["c"]), both, {d: r[1] for d, r in runs.items()}

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        p, both, traces = self.forward(x, mask, True)
        total = max(mask.sum(), 1)
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total)
        dz = ((p - y) * mask / total).astype(np.float32)
        t, b, size = x.shape
        n = self.hidden
        g = {"o": both.reshape(t * b, -1).T @ dz.reshape(-1, 1), "c": dz.sum(keepdims=True).reshape(1)}
        down = dz[:, :, None] * self.w["o"][:, 0]
        for d in "fb":
            dout = down[:, :, :n] if d == "f" else down[:, :, n:]
            dh, dc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
            dzs = np.zeros((t, b, 4 * n), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            for k in range(t - 1, -1, -1) if d == "f" else range(t):
                h0, c0, i, f, o, gg, th, m = traces[d][k]
                dh = (dh + dout[k]) * m
                dc = (dc + dh * o * (1 - th * th)) * m
                z = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                dzs[k] = z
                gh += h0.T @ z
                dh, dc = z @ self.w[f"h{d}"].T, dc * f
            g |= {f"h{d}": gh, f"x{d}": x.reshape(t * b, -1).T @ dzs.reshape(t * b, -1), f"b{d}": dzs.sum((0, 1))}
        return loss, g

    def long_labels(self, found: list) -> np.ndarray:
        """As labels(), of one page of any length; what is in memory at once has a bound, but for a number a block."""
        z, n = np.zeros(len(found), np.float32) + self.w["c"], self.hidden
        cuts = range(0, len(found), TOGETHER)
        for d, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            state = None
            for k in cuts if d == "f" else reversed(cuts):
                x = features(found, k, k + TOGETHER)[:, None]
                out, _, state = self._run(x, np.ones(x.shape[:2], np.float32), d, False, state)
                z[k : k + TOGETHER] += (out @ self.w["o"][part])[:, 0, 0]
        return _sig(z)

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of main text for each block of each page."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest, take = len(pages[order[-1]]), 1
            while take < len(order) and (take + 1) * longest <= TOGETHER and 2 * len(pages[order[-take - 1]]) >= longest:
                take += 1
            own, order = order[-take:], order[:-take]
            x, mask, _ = padded([(pages[k], None) for k in own])
            p = self.forward(x, mask)[0]
            for j, k in enumerate(own):
                out[k] = p[: len(pages[k]), j]
        return out


def padded(rows: list[tuple[np.ndarray, list[int] | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(len(x) for x, _ in rows)
    x, mask, y = np.zeros((t, len(rows), SIZE), np.float32), np.zeros((t, len(rows)), np.float32), np.zeros((t, len(rows)), np.float32)
    for k, (f, own) in enumerate(rows):
        x[: len(f), k], mask[: len(f), k] = f, 1
        if own is not None:
            y[: len(f), k] = own
    return x, mask, y


@lru_cache
def trained(seed: int = 11, pages: int = PAGES, passes: int = PASSES) -> Labeller:
    """A labeller taught on made-up pages; the same for the same arguments."""
    model = Labeller(seed)
    rows = [(features(b), y) for b, y in labelled(seed, pages) if b]
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    steps = passes * -(-len(rows) // STEP)
    done = 0
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), STEP):
            x, mask, y = padded([rows[k] for k in order[at : at + STEP]])
            # names that are not known must not decide: leave out some at random
            x[:, :, :PATHS] *= rng.random((1, x.shape[1], PATHS)) > 0.1
            x[:, :, PATHS : PATHS + WORDS] *= rng.random((1, x.shape[1], WORDS)) > 0.4
            _, g = model.gradients(x, mask, y)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            done += 1
            rate = 0.01 * (1 - done / (steps + 1))
            for k, v in g.items():
                v = v / max(1.0, norm)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                model.w[k] -= (rate * first[k] / (1 - 0.9**done) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-6)).astype(np.float32)
    return model


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    labels = model.labels([features(b if len(b) <= TOGETHER else []) for b in found])
    labels = [y if len(b) <= TOGETHER else model.long_labels(b) for b, y in zip(found, labels)]
    return ["\n".join(t for (_, t, _), p in zip(b, y) if p >= 0.5) for b, y in zip(found, labels)]


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """One row per page: id, url, text, n_chars.

    text has the main blocks in page order, one a line, with runs of white space as one space and character references decoded; it is
    empty for a null or empty page and for one without main text. Rows that repeat an id get a row each; null ids
    and urls stay null. An empty table gives no rows. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                texts = main_texts(shared.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    out = slim.mapInArrow(run, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op3_html_extract": op3_html_extract}
ORACLES: dict = {}

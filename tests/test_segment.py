"""Chinese words: cuts against all cuts there are, dictionaries from files and from corpora."""

import itertools
import random
import time

import duckdb
import pytest

from quillspark.functions.packs import ZH, with_frequencies, with_words
from quillspark.functions.segment import ALONE, BEFORE, FIRST, INNER, LAST, NEVER, Segmenter
from quillspark.operators import lexicons as L
from quillspark.operators import parse as P
from quillspark.operators.kernels import Kernel
from quillspark.plans import sql as S
from quillspark.sources import readers

GIVEN = {
    "中华": 100, "人民": 800, "共和国": 300, "人民共和国": 50, "中华人民共和国": 200, "成立": 500, "了": 9000, "他": 9000, "从": 5000,
    "马上": 400, "马": 600, "上": 3000, "下来": 700, "上下": 100, "来": 3000, "下": 3000, "研究": 900, "研究生": 300, "生命": 400, "命": 80, "生": 200, "起源": 90, "的": 9000,
}


def all_cuts(text):
    for marks in itertools.product([0, 1], repeat=len(text) - 1):
        ends = [k + 1 for k, m in enumerate(marks) if m] + [len(text)]
        yield [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def test_cut_is_the_cheapest_of_all():
    rng = random.Random(2)
    for trial in range(200):
        signs = "甲乙丙丁戊"
        own = {"".join(rng.choices(signs, k=rng.randint(1, 4))): rng.randint(1, 60) for _ in range(12)}
        s = Segmenter(own)
        text = "".join(rng.choices(signs, k=rng.randint(1, 9)))
        price = lambda cut: sum(s.words.get(w, s.alone if len(w) == 1 else NEVER) for w in cut)  # noqa: B023, E731
        best = min(map(price, all_cuts(text)))
        got = s.path(text)
        assert "".join(got) == text and price(got) == best
        # of equal ones, the one whose words are longer from the first on
        assert [len(w) for w in got] == max([len(w) for w in c] for c in all_cuts(text) if price(c) == best)


def test_unknown_stretches_by_the_cheapest_places():
    rng = random.Random(3)
    s = Segmenter(GIVEN)
    for _ in range(60):
        text = "".join(rng.choices("研究生命来下上马甲乙", k=rng.randint(2, 6)))
        own = [s.signs.get(c, s.unknown) for c in text]

        def price(places):
            total = s.start[places[0]] + own[0][places[0]]
            for e, (a, b) in zip(own[1:], itertools.pairwise(places), strict=True):
                if a not in BEFORE[b]:
                    return NEVER
                total += s.move[a][b] + e[b]
            return total if places[-1] in (LAST, ALONE) else NEVER

        best = min(map(price, itertools.product(range(4), repeat=len(text))))
        got = s.joined(text)
        places = [p for w in got for p in ([ALONE] if len(w) == 1 else [FIRST, *[INNER] * (len(w) - 2), LAST])]
        assert "".join(got) == text and price(places) == best


def test_known_sentences():
    cut = Segmenter(GIVEN).cut
    assert cut("中华人民共和国成立了") == ["中华人民共和国", "成立", "了"]
    assert cut("人民共和国") == ["人民共和国"]
    assert cut("他从马上下来") == ["他", "从", "马上", "下来"]
    assert cut("研究生命的起源") == ["研究", "生命", "的", "起源"]
    assert cut("") == [] and cut(" ,a1 了。") == [",", "a1", "了", "。"]
    assert Segmenter({}).cut("甲乙") in (["甲乙"], ["甲", "乙"])


@pytest.mark.parametrize("cutter", [ZH.cutter, Segmenter(GIVEN), Segmenter({})])
def test_sql_gives_the_same_cut(cutter):
    rng = random.Random(4)
    signs = "的了在是我城市人工智能研究者可持续因此综上所述有一中华民共和国马上下来生命起源甲乙"
    texts = ["", "的", "abc，", *("".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(300))]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    got = dict(con.execute(f"SELECT k, {S.segmented('text', cutter)} FROM t").fetchall())
    assert all((got[k] or []) == cutter.cut(t) for k, t in enumerate(texts))


def test_packs_with_dictionaries(spark, tmp_path):
    (tmp_path / "words.txt").write_text("".join(f"{w} {n} n\n" for w, n in GIVEN.items()) + "坏行\n\n  研究  100  \n甲乙 x\n", encoding="utf-8")
    own = L.frequencies(readers.dictionary(spark, str(tmp_path / "words.txt")))
    assert own == GIVEN | {"研究": 1000}
    assert Kernel(with_frequencies(ZH, own)).tokens("他从马上下来。") == ["他", "从", "马上", "下来", "。"]
    assert list(L.frequencies(readers.dictionary(spark, str(tmp_path / "words.txt")), 2)) == ["了", "他"]
    rows = spark.createDataFrame([("他从马上下来",), (None,), ("",)], "text string")
    got = rows.select(P.tokens(rows.text, with_frequencies(ZH, own)).alias("t")).collect()
    assert [r.t for r in got] == [["他", "从", "马上", "下来"], None, []]


def test_frequencies_learnt_from_a_corpus(spark):
    """Words of a made-up language come out of its texts, most of their places too."""
    rng = random.Random(5)
    signs = [chr(0x4E00 + k) for k in rng.sample(range(3000), 260)]
    words = list({"".join(rng.sample(signs, rng.choice([1, 2, 2, 2, 3]))) for _ in range(160)})
    weights = [1 / (k + 3) for k in range(len(words))]
    sentences = [rng.choices(words, weights, k=rng.randint(4, 14)) for _ in range(4000)]
    texts = spark.createDataFrame([("，".join("".join(s) for s in sentences[k : k + 5]),) for k in range(0, 4000, 5)], "text string")
    own = L.learn(texts)
    used = {w for s in sentences for w in s}
    several = {w for w in used if len(w) > 1}
    assert len(several & own.keys()) >= 0.9 * len(several)
    cut = Segmenter(own).run
    want, got = set(), set()
    for k, s in enumerate(sentences):
        for into, own_words in ((want, s), (got, cut("".join(s)))):
            at = 0
            for w in own_words:
                into.add((k, at, w))
                at += len(w)
    assert len(want & got) >= 0.93 * len(want)
    # counting is by distinct runs with their number, so it equals plain counting
    plain = {}
    for s in sentences:
        for w in cut("".join(s)):
            plain[w] = plain.get(w, 0) + 1
    assert {r.word: r.n for r in L.counted(L._runs(texts, "text"), Segmenter(own)).collect()} == plain


def test_nothing_to_learn(spark):
    for rows in ([], [(None,)], [("abc",)]):
        assert L.learn(spark.createDataFrame(rows, "text string")) == {}


def test_terms_widen_the_pack():
    text = "因此，他研究残差网络的效率。Top1为 92%"
    assert Kernel(ZH).tokens(text) == ["因此", "，", "他", "研究", "残差", "网络", "的", "效率", "。", "top1", "为", "92", "%"]
    wide = with_words(ZH, ["残差网络"])
    assert Kernel(wide).tokens(text)[4] == "残差网络"
    assert Kernel(wide).values(text, None)[3] > Kernel(ZH).values(text, None)[3] == 0


def test_cuts_are_those_of_the_plain_search_and_long_runs_take_no_longer_a_sign():
    """Against every word length and every place at every sign; and a run of unknown signs four times as long takes about four times as long."""
    rng = random.Random(11)
    signs = [chr(0x4E00 + k) for k in range(40)]

    def plain_path(s, run):
        best, size = [0] * (len(run) + 1), [1] * len(run)
        for i in range(len(run) - 1, -1, -1):
            best[i] = s.words.get(run[i], s.alone) + best[i + 1]
            for k in range(2, min(s.longest, len(run) - i) + 1):
                own = s.words.get(run[i : i + k])
                if own is not None and own + best[i + k] <= best[i]:
                    best[i], size[i] = own + best[i + k], k
        out, i = [], 0
        while i < len(run):
            out.append(run[i : i + size[i]])
            i += size[i]
        return out

    def plain_joined(s, run):
        own = [s.signs.get(x, s.unknown) for x in run]
        costs, back = [s.start[p] + own[0][p] for p in range(4)], []
        for e in own[1:]:
            came = [min((costs[b] + s.move[b][p], b) for b in BEFORE[p]) for p in range(4)]
            costs = [c + e[p] for p, (c, _) in enumerate(came)]
            back.append([b for _, b in came])
        place, ends = min((LAST, ALONE), key=lambda p: (costs[p], p)), [len(run)]
        for k in range(len(run) - 1, 0, -1):
            place = back[k - 1][place]
            if place in (LAST, ALONE):
                ends.append(k)
        return [run[a:b] for a, b in zip([0, *ends[:0:-1]], ends[::-1], strict=True)]

    for _ in range(60):
        s = Segmenter({"".join(rng.choices(signs, k=rng.randint(1, 6))): rng.randint(1, 90) for _ in range(rng.randint(0, 80))})
        for _ in range(20):
            run = "".join(rng.choices(signs, k=rng.randint(1, 30)))
            assert s.path(run) == plain_path(s, run) and s.joined(run) == plain_joined(s, run)
    took = []
    for n in (20_000, 80_000):
        run, begin = "".join(rng.choices(signs, k=n)), time.process_time()
        assert "".join(s.joined(run)) == run
        took.append(time.process_time() - begin)
    assert took[1] < 8 * took[0], took

"""Values and rules that SQL does not fix: small cases worked out by hand or by loops."""

import io
import itertools
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions.packs import LATIN, ZH
from quillspark.functions.thresholds import RULE_DIMENSIONS, zone
from quillspark.operators import dimensions as D
from quillspark.operators import fusion as U
from quillspark.operators import parse as P
from quillspark.operators import sentences as T
from quillspark.operators import spans as X
from quillspark.sources import files, readers, sinks
from quillspark.streaming import scan


def loop(zones, scores):
    """The spread as a loop over a list that changes under way."""
    z, s = list(zones), list(scores)
    rank = {"green": 0, "yellow": 1, "orange": 2, "red": 3}
    for i in range(1, len(z) - 1):
        top = max(z[i - 1], z[i + 1], key=rank.get)
        if z[i] == "green" and top != "green":
            z[i], low = {"red": ("orange", 0.22), "orange": ("yellow", 0.10), "yellow": ("yellow", 0.08)}[top]
            s[i] = max(s[i], low)
        elif z[i] == "yellow" and top == "red":
            z[i], s[i] = "orange", max(s[i], 0.20)
    return z, s


def test_spread_is_the_loop(spark):
    names = ("green", "yellow", "orange", "red")
    cases = [c for n in range(1, 7) for c in itertools.product(names, repeat=n)]
    rows = [(k, 0, i, z, 0.05) for k, c in enumerate(cases) for i, z in enumerate(c)]
    got = T.propagated(spark.createDataFrame(rows, "doc_id long, p_idx int, s_idx int, zone string, score double").repartition(8))
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, {})[r.s_idx] = (r.zone, r.score)
    for k, c in enumerate(cases):
        z, s = loop(c, [0.05] * len(c))
        assert [found[k][i] for i in range(len(c))] == list(zip(z, s)), c


def test_zones_are_not_monotone(spark):
    by = {d[0]: d for d in RULE_DIMENSIONS}
    rows = spark.createDataFrame([(x,) for x in (18.5, 15.0, 8.0, 6.0, 2.0, 1.9)], "x double")
    got = {r.x: r.z for r in rows.select("x", zone(F.col("x"), by["connector_density"]).alias("z")).collect()}
    assert got == {18.5: "gray", 15.0: "ai", 8.0: "ai", 6.0: "human", 2.0: "human", 1.9: "gray"}


def test_fused_levels(spark):
    rows = spark.createDataFrame([("green", 0, 0, "green"), ("red", 4, 2, "red"), ("red", 5, 5, "deep_red"), ("yellow", 2, 1, "yellow"), ("red", 3, 0, "yellow"), ("yellow", 2, 0, "yellow")], "l string, a int, s int, want string")
    assert all(r.got == r.want for r in rows.select("want", U.fused_level(F.col("l"), F.col("a"), F.col("s")).alias("got")).collect())


def test_guard_rules(spark):
    human = "我觉得这像旧梦一样，不是冷漠，也不是疏远，而是亲近，我的心不禁跳着，走着，笑着，难道不是吗"
    rows = spark.createDataFrame([(0, 0, t, lv, 1.0) for t in (human, "平白的一句说明文字没有什么特点可言只是很长很长地写下去而已") for lv in ("green", "yellow", "red", "deep_red")], "doc_id long, p_idx int, text string, level string, comprehensive_score double")
    got = {(r.human_score >= 5, r.original_level): (r.level, r.comprehensive_score) for r in D.guarded(rows).collect()}
    assert got[True, "deep_red"] == ("red", 0.5) and got[True, "red"] == ("yellow", 0.5) and got[True, "green"] == ("green", 1.0)
    assert got[False, "deep_red"] == ("deep_red", 1.0)


def test_paragraph_numbers_are_dense_after_short_ones_go(spark):
    df = spark.createDataFrame([(1, "短。\n\n这是足够长的第一个段落内容。\n \n短\n\n这是足够长的第二个段落内容。"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.p_idx, r.prev != "") for r in P.paragraphs(df, ZH).orderBy("p_idx").collect()]
    assert got == [(1, 0, False), (1, 1, True)]


def test_statistics_do_not_depend_on_partitions(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    rows = lambda d: sorted(map(str, D.dimensions(P.paragraphs(d, LATIN), LATIN).collect()))
    assert rows(df) == rows(df.repartition(7))


@pytest.mark.parametrize("text", ["", "文献[1]指出，准确率为92.3%，见图 3 与 (王某 2024)。", "`a` 与 f(x) 及 https://x.y/z 《书名》 第3章 北京市", 'plain "quoted words" and Fig 2.', "无"])
def test_mask_and_restore(spark, text):
    rows = X.restored(X.masked(X.protected(spark.createDataFrame([(text,)], "text string"))))
    r = rows.collect()[0]
    spans = r.protected_spans
    assert [text[s.start : s.end] for s in spans] == [s.text for s in spans]
    if all(a.end <= b.start for a, b in zip(spans, spans[1:])):
        assert r.restored_text == text
    if spans:
        assert re.search(r"__[A-Z_]+_\d+__", r.masked_text)


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>" for t, s in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("Title", "H1"), ("", None), ("Short", None)]))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    rows = readers.docx_files(spark, str(tmp_path / "*.docx")).collect()
    assert sorted((r.p_idx, r.style, r.text) for r in rows if r.error is None) == [(0, "heading 1", "Title"), (1, "Normal", "Short")]
    assert sum(r.error is not None for r in rows) == 1
    (tmp_path / "t.txt").write_text("第一段。\n\n第二段。", encoding="utf-8")
    (tmp_path / "g.txt").write_bytes(("汉字编码" * 20).encode("gbk"))
    assert readers.documents_from(spark, str(tmp_path / "t.txt")).collect()[0].text == "第一段。\n\n第二段。"
    assert readers.documents_from(spark, "只是文字，\n不是路径").collect()[0].text.startswith("只是")
    assert readers.documents_from(spark, str(tmp_path / "a.docx")).collect()[0].text == "Title\n\nShort"
    got = {r.path[-5:]: r.text for r in readers.decoded_files(spark, str(tmp_path / "*.txt")).collect()}
    assert got["g.txt"] == "汉字编码" * 20 and got["t.txt"].startswith("第一段")
    (tmp_path / "ref.md").write_text("\n---\n".join(["x" * 60, "short", "y" * 80]), encoding="utf-8")
    assert [r.text[0] for r in readers.reference_corpus(spark, str(tmp_path / "ref.md")).collect()] == ["x", "y"]
    (tmp_path / "reg.md").write_text("z" * 70, encoding="utf-8")
    assert [(r.ref, r.text[0]) for r in readers.reference_corpus(spark, str(tmp_path / "re*.md"), most=2).collect()] == [(0, "x"), (1, "y")]
    assert [(r.ref, r.text[0]) for r in readers.reference_corpus(spark, str(tmp_path / "re*.md")).collect()] == [(0, "x"), (1, "y"), (2, "z")]
    (tmp_path / "terms.json").write_text('{"discipline": "x",\n "terms": ["残差网络", "摘要"]}', encoding="utf-8")
    assert {r.term for r in readers.terms(spark, str(tmp_path / "terms.json")).collect()} == {"残差网络", *readers.COMMON_TERMS}
    assert readers.terms(spark).count() == len(readers.COMMON_TERMS)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "<b>", "red", 0.5), (1, 1, "ok", "green", 0.0)], "doc_id long, p_idx int, text string, level string, comprehensive_score double")
    page = "".join(sinks.html_report(rows))
    assert "&lt;b&gt;" in page and "<b>" not in page.replace("</body>", "")
    assert [x.split("\t")[1] for x in sinks.terminal_report(rows)] == ["1", "1"]
    sinks.write_json(spark.createDataFrame([(1, 0, '{"a":1}')], "doc_id long, p_idx int, json string"), str(tmp_path / "out"))
    assert [r.value for r in files.lines(spark, str(tmp_path / "out")).collect()] == ['{"a":1}']
    sinks.write_html(rows, str(tmp_path / "pages"))
    (page,) = spark.read.format("textfiles").load(str(tmp_path / "pages")).collect()
    assert page.name == "1" and page.text.count("<section") == 2 and "&lt;b&gt;" in page.text


def test_stream_is_the_batch(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    batch = sorted(map(tuple, scan.levels(docs).collect()))
    assert sorted(map(tuple, scan.drained(scan.levels(scan.table_stream(spark, sf, "documents"))).collect())) == batch


def test_nested_phrases_count_each_for_itself():
    from quillspark.functions.phrases import Occurrences

    assert Occurrences(["与此同时", "同时"]).total("与此同时，同时。") == 3


def test_entropy_by_counting(spark):
    import math
    from collections import Counter

    rng = random.Random(2)
    texts = ["".join(rng.choices("abc 。，é", k=rng.randint(11, 60))) for _ in range(30)]
    df = spark.createDataFrame([(k, 0, t, "") for k, t in enumerate(texts)], "doc_id long, p_idx int, text string, prev string")
    for r in D.dimensions(df, LATIN).collect():
        c = Counter(r.text.replace(" ", "").replace("\n", ""))
        n = sum(c.values())
        assert abs(r.overall_entropy + sum(v / n * math.log2(v / n) for v in c.values())) < 1e-9


def test_pool_of_any_size(spark):
    from quillspark.operators import semantic as V

    rng = random.Random(4)
    refs = [[rng.random() for _ in range(4)] for _ in range(1203)]
    own = [[rng.random() for _ in range(4)] for _ in range(20)]
    rows = spark.createDataFrame([(k % 15, v) for k, v in enumerate(own)], "k int, vec array<double>")
    got = V.pool_similarity(rows, spark.createDataFrame([(r,) for r in refs], "ref array<double>"), ["k"])
    want = [(k % 15, max(sum(a * b for a, b in zip(v, r)) for r in refs)) for k, v in enumerate(own)]
    assert sorted((r.k, round(r.similarity, 9)) for r in got.collect()) == sorted((k, round(x, 9)) for k, x in want)
    assert {r.similarity for r in V.pool_similarity(rows, spark.createDataFrame([], "ref array<double>"), ["k"]).collect()} == {None}


def test_gaps_and_levels_have_all_statistics(spark, tmp_path):
    from quillspark.plans import registry

    words = "old house near river stood empty years before family came back again with winter stores".split()
    text = "\n\n".join("The " + " ".join(words[: 15 - k] + [w + str(k) for w in words[:k]]) + "." for k in range(5))
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    wide = {r.p_idx: r.paragraph_similarity for r in run("dims_wide")}
    long = {r.p_idx: r for r in run("dims_long") if r.dim == "paragraph_similarity"}
    assert {k: r.value for k, r in long.items()} == pytest.approx(wide, abs=1e-4) and max(wide.values()) > 0.5
    assert {r.p_idx for r in run("ranked_gaps") if r.dim == "paragraph_similarity"} == {k for k, r in long.items() if r.zone == "ai"} != set()
    levels = run("paragraph_levels")
    whole = next(r for r in run("levels_rollup") if r.lang is None and r.source is None)
    assert whole.mean_score == pytest.approx(sum(r.comprehensive_score for r in levels) / len(levels), abs=1e-5)


# Short texts, and what was worked out for them by hand: signs, sentences, deviation of lengths, connectors and slop per 1000, entropy of marks and of signs.
GOLDEN = [
    ("此外，注意力机制的出现进一步推动了自然语言处理领域的发展，Transformer架构已经成为当前主流的基础模型。值得注意的是，这些技术突破不仅提升了模型的性能表现，也为后续的研究工作奠定了坚实的基础。", 100, 2, 0.0, 20.0, 0.0, 0.9183, 6.0922),
    ("综上所述，深度学习技术的持续演进正在深刻改变人工智能领域的研究范式。未来的研究方向可能会更加注重多模态融合、小样本学习以及模型的可解释性。这些新兴方向将推动AI技术向更通用、更可信的方向发展。", 96, 3, 3.5590, 10.4167, 20.8333, 1.4591, 5.9742),
    ("我们做了个实验，拿两组模型对比了一下。第一组就是标准的CNN，直接在ImageNet上跑，top-1大概76%。第二组加了我们自己搞的注意力分支——其实就是让网络学会哪些区域比较重要。", 92, 3, 8.2597, 0.0, 0.0, 1.5613, 6.0043),
    ("结果还挺意外的。加了注意力之后，准确率涨到了81%，而且参数量只多了不到3M。不过说实话，在小数据集上效果会打折扣。我们怀疑可能是过拟合了。", 70, 4, 8.7321, 42.8571, 0.0, 0.9852, 5.6614),
    ("后面换了几种数据增强的策略，情况好了不少。当然这玩意儿到底有没有用还得看具体场景，不是所有任务都适合。这一点后面还得细琢磨。", 62, 3, 7.7603, 0.0, 0.0, 0.9710, 5.5427),
]


def test_golden_values(spark):
    df = spark.createDataFrame([(k, 0, row[0], "") for k, row in enumerate(GOLDEN)], "doc_id long, p_idx int, text string, prev string")
    got = {r.doc_id: r for r in D.dimensions(df, ZH).collect()}
    sent = {r.doc_id: r.n for r in P.sentences(df, ZH).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for k, (text, n, sentences, *want) in enumerate(GOLDEN):
        r = got[k]
        assert (len(text), sent[k]) == (n, sentences)
        assert [r.sentence_length_std, r.connector_density, r.slop_density, r.punctuation_entropy, r.overall_entropy] == pytest.approx(want, abs=1e-4)


def test_no_statistic_of_chinese_words_is_constant(spark, sf):
    from quillspark.plans import registry

    rows = registry.QUERIES["zh_dims_wide"](spark, sf).collect()
    for name in ("info_density", "term_density", "hapax_ratio", "zipf_deviation", "bigram_repetition", "trigram_repetition"):
        assert len({r[name] for r in rows}) > 5, name


def test_guard_reason(spark):
    text = "我觉得这像旧梦一样，难道不是吗"
    rows = spark.createDataFrame([(0, 0, text, lv, 1.0) for lv in ("green", "deep_red")], "doc_id long, p_idx int, text string, level string, comprehensive_score double")
    got = {r.original_level: r for r in D.guarded(rows).collect()}
    assert got["green"].guard_reason == "" and got["deep_red"].guard_reason == "检测到经典文学特征（排比/拟人/诗化语言），降级处理"
    marks = D.human_marks(F.col("text"))
    assert spark.createDataFrame([("我觉得，难道不禁",), ("无",)], "text string").select(marks.alias("m")).collect() == [("['第一人称叙事', '口语反问', '情感强度词', '短句节奏']",), ("[]",)]


def test_spans_against_the_rule():
    rng = random.Random(6)
    bits = ["[1]", "(2024)", "3.14", "f(x)", "《书》", "《f(x) 2.5》", "`a [2]`", '"quo ted"', "图 3", "北京大学", "第3章", "abc:", "某某某：", " ", "字", "http://a.b/c[3]"]
    for _ in range(400):
        text = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        want = []
        for pattern, label in X.PATTERNS:
            for m in re.finditer(pattern, text):
                covered = {i for a, b, _ in want for i in range(a, b)}
                if m.start() not in covered and m.end() - 1 not in covered:
                    want.append((m.start(), m.end(), label))
        assert [(s["start"], s["end"], s["label"]) for s in X.spans_of(text)] == sorted(want, key=lambda s: s[0]), text


def test_instructions(spark):
    rows = [("slop_density", "Slop词密度", 5.0, 4.0), ("sem_argument_linearity", "x", 0.1, 0.5), ("argument_linearity", "论证线性度（全局）", 0.00005, 0.00045), ("semantic_backtrack", "语义回溯率（全局）", 0.0, 0.1), ("other", "o", 0.000125, 0.2)]
    report = spark.createDataFrame([(1, 0, *r, k + 1) for k, r in enumerate(rows)], "doc_id long, p_idx int, dim string, description string, value double, gap double, rank int")
    got = [r.instruction for r in U.instructions(spark, report).orderBy("rank").collect()]
    assert got[0] == U.INSTRUCTIONS["slop_density"] and got[1] == U.INSTRUCTIONS["sem_argument_linearity"]
    assert got[2:] == ["减少 论证线性度（全局） 的AI特征 (当前: 5e-05, 差距: 0.00)", "减少 语义回溯率（全局） 的AI特征 (当前: 0.0, 差距: 0.10)", "减少 o 的AI特征 (当前: 0.000125, 差距: 0.20)"]
    values = [0.0, 1.0, 0.7, 0.1234, 0.0001, 0.000013, 0.00001, 0.000099, 0.000007, 12.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.s for r in df.select(U.number(F.col("v")).alias("s")).collect()] == [str(v) for v in values]


def test_an_encoder_and_one_that_fails(spark):
    from quillspark.operators import semantic as V

    rows = [(1, k, f"Paragraph {w} stands here. And {w} ends it.") for k, w in enumerate(["one", "two", "three"])] + [(2, 0, "A document of one paragraph only.")]
    par = spark.createDataFrame(rows, "doc_id long, p_idx int, text string")

    def make():
        return lambda texts: [[1.0, 0.0] if "two" in t else [0.6, 0.8] for t in texts]

    got = {(r.p_idx, r.dim): r.value for r in V.semantic(par, LATIN, make).collect()}
    assert got[0, "paragraph_semantic_similarity"] == got[1, "transition_naturalness"] == 0.6 and got[2, "transition_naturalness"] == 0.0 and len(got) == 12
    assert {r.doc_id: r.error for r in V.semantic_documents(par, LATIN, make).collect()} == {1: None, 2: V.TOO_SHORT}

    def broken():
        raise RuntimeError("no model")

    assert V.semantic(par, LATIN, broken).count() == 0
    assert {r.doc_id: r.error for r in V.semantic_documents(par, LATIN, broken).collect()} == {1: V.NOT_ENCODED, 2: V.TOO_SHORT}
    assert sorted(str(r.transition) for r in V.transitions(par, LATIN, broken).collect()) == ["0.5", "0.5", "None", "None"]


def test_matrix_and_join_match_alike(spark, sf):
    from quillspark.operators import models as M

    refs = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text").limit(80)
    vocabulary, weights = M.char_model(refs, "item_id")
    one, two = ({(r.conv_id, r.turn): r.similarity for r in M.best_match(rows, ["conv_id", "turn"], vocabulary, weights, most=most).collect()} for most in (10**9, 0))
    assert one == pytest.approx(two, abs=1e-9) and max(one.values()) > 0


def test_matrix_and_walk_match_alike(spark, sf):
    """Texts met by rows of one matrix, word by word, and n-gram by n-gram."""
    from quillspark.operators import models as M

    refs = spark.read.parquet(f"{sf}/benchmark.parquet")
    odd = spark.createDataFrame([(-1, 0, None), (-1, 1, "short"), (-1, 2, "  \n\t          "), (-1, 3, "\u4e00" * 20)], "conv_id long, turn int, text string")
    rows = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("CAST(conv_id AS long) conv_id", "CAST(turn AS int) turn", "text").limit(80).unionByName(odd)
    vocabulary, weights = M.char_model(refs, "item_id")
    one, two = ({(r.conv_id, r.turn): r.similarity for r in M.best_match(rows, ["conv_id", "turn"], vocabulary, weights, entries=n).collect()} for n in (10**9, 0))
    assert len(one) == 84 and one == pytest.approx(two, abs=1e-9) and max(one.values()) > 0


def test_tables_are_dealt_by_their_rows(spark):
    """Counting takes longer than bytes tell: a small file of many texts is more than a task a core, and rows dealt by a key stay there for windows."""
    from quillspark.sources.readers import spread

    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "id % 90 AS conv_id")
    assert spread(rows, most=20).rdd.getNumPartitions() == 50
    dealt = spread(rows, "conv_id", most=20)
    assert dealt.rdd.getNumPartitions() == 50 and dealt.count() == 1000
    whole = dealt.selectExpr("conv_id", "row_number() OVER (PARTITION BY conv_id ORDER BY id) AS k")
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_models_are_kept(spark, tmp_path):
    from quillspark.operators import models as M

    refs = spark.createDataFrame([(0, "some words and some more words")], "item_id long, text string")
    model = M.bigram_model(refs, LATIN)
    M.save(model, str(tmp_path / "m"))
    assert sorted(M.load(spark, str(tmp_path / "m")).collect()) == sorted(model.collect())


def test_before_and_after(spark):
    from quillspark.operators import compare

    before = spark.createDataFrame([(1, 0, "red"), (1, 1, "green"), (1, 2, "yellow"), (2, 0, "deep_red")], "doc_id long, p_idx int, fused_level string")
    after = spark.createDataFrame([(1, 0, "green"), (1, 1, "yellow"), (1, 2, "yellow"), (3, 0, "red")], "doc_id long, p_idx int, level string")
    rows = compare.compared(before, after)
    assert {(r.doc_id, r.p_idx): r.change for r in rows.collect()} == {(1, 0): "better", (1, 1): "worse", (1, 2): "same", (2, 0): "removed", (3, 0): "added"}
    assert tuple(compare.high_risk(rows).collect()[0]) == (2, 1)


def test_job(spark, tmp_path, capsys):
    import json

    from quillspark import job

    (tmp_path / "t.txt").write_text("\n\n".join(t for t, *_ in GOLDEN), encoding="utf-8")
    for more in ([], ["--no-embedding"]):
        assert job.main([str(tmp_path / "t.txt"), "--format", "json", *more], spark) == 0
        rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
        assert [r["paragraph_index"] for r in rows] == [0, 1, 2, 3, 4] and {r["total_dimensions"] for r in rows} == ({12} if more else {16})
        assert all(g["gap"] >= h["gap"] for r in rows for g, h in zip(r["gaps"], r["gaps"][1:]))
    assert job.main([str(tmp_path / "t.txt"), "--format", "html", "--output", str(tmp_path / "o.html")], spark) == 0
    assert spark.read.format("textfiles").load(str(tmp_path / "o.html")).first().text.count("<section") == 5
    assert job.main([str(tmp_path / "t.txt")], spark) == 0 and "#5" in capsys.readouterr().out
    assert job.main(["短", "--format", "terminal"], spark) == 1
    assert job.main([str(tmp_path / "t.txt"), "--format", "rates"], spark) == 0
    assert json.loads(capsys.readouterr().out)["verdict"] in ("high", "partial", "safe")
    assert job.main(["--status"]) == 0


def test_documents_that_are_not_scanned(spark):
    docs = spark.createDataFrame([(1, "too short"), (2, None), (3, "x. " * 10), (4, "One line that is long enough to be a paragraph.")], "doc_id long, text string")
    got = {r.doc_id: r.error for r in sinks.refusals(docs, P.paragraphs(docs, LATIN)).collect()}
    assert got == {1: "文本太短", 2: "文本太短", 3: None, 4: None}
    one = sinks.document_json(spark.createDataFrame([(1, 0, '{"a":1}'), (1, 1, '{"a":2}')], "doc_id long, p_idx int, json string"), spark.createDataFrame([(1, 0, "red"), (1, 1, "green")], "doc_id long, p_idx int, level string"))
    assert one.collect()[0].json == '{"summary":{"total_paragraphs":2,"high_risk":1,"suspicious":0,"safe":1},"paragraphs":[{"a":1},{"a":2}]}'


def test_updates_of_a_stream_replace_earlier_rows(spark, tmp_path):
    from datetime import datetime

    for k in range(3):
        spark.createDataFrame([(datetime(2024, 1, 1, k), "a", 1.0)], "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    source = scan.table_stream(spark, str(tmp_path), "events", 1)
    rows = scan.drained(scan.event_counts(source), ("day", "event_type")).collect()
    assert [(r.event_type, r.n, r.total) for r in rows] == [("a", 3, 3.0)]

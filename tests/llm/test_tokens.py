"""Token files and packing, against plain encoding of whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing, token_output
from quillspark.llm._tokens import Encoder

ODD = [
    "",
    " ",
    "\n\n",
    None,
    "Hello,  world.\tIt's fine -- don't!",
    "a.b,c été İstanbul ΣΣ x\u0085y\x1cz",
    "<|endoftext|> <|startoftext|>end<|endoftext|>",
    "漢字かな交じり文。 Ünïcödé straße ÀÉ÷×",
    "foo***.bar,### 3.14 x_1's 'll ``q'' \r\n  tail \t",
    "word " * 3000 + "x" * 5000,
    "a\t \n b  c\n",
    "don't.'s we'll,'re",
]


def plain(file):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_as_whole_texts(file, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(300).collect()] + ODD
    enc, ids = Encoder(public_tokenizers.path(file), kept=500), plain(file)
    for k in range(0, len(texts), 50):
        part = [t or "" for t in texts[k : k + 50]]
        for t, a in zip(part, enc.encode(part)):
            assert a.tolist() == ids(t), t[:80]


def test_rank_coding_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001, 300_000):
        r = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_output.pack_ranks(r)
        assert (token_output.unpack_ranks(control, data, n) == r).all()


def test_token_files(spark, tmp_path):
    rows = [(k * 7 % 13 if k else None, t, "x") for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = [r.asDict() for r in token_output.token_output(docs, public_tokenizers.path("word_bpe_49k.json"), 2).collect()]
    ids, at = plain("word_bpe_49k.json"), 0
    got.sort(key=lambda r: r["start"])
    for (name, text, _), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), got, strict=True):
        want = np.array([*ids(text), 2], "<u4")
        assert r == {"doc_id": name, "start": at, "n_tokens": len(want), "ids_crc32": zlib.crc32(want.tobytes())}
        at += len(want)
    assert token_output.token_output(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0


def test_many_rows_of_one_id_may_stand_in_several_files(spark, tmp_path):
    rows = [(None if k % 2 else 7, f"text number {k} " * (k % 5)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        files = token_output.write_tokens(docs, str(tmp_path), public_tokenizers.path("word_bpe_49k.json"), 2)
    finally:
        spark.conf.unset(key)
    assert files.count() > 2
    got = sorted(token_output.read_tokens(spark, files).collect(), key=lambda r: r.start)
    ids, at = plain("word_bpe_49k.json"), 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [None] * 200 + [7] * 200
    want = [np.array([*ids(t), 2], "<u4") for _, t in rows]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or 0, len(w), zlib.crc32(w.tobytes())) for (d, _), w in zip(rows, want))


def check_pieces(pieces, docs, ids):
    longest = 2048
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= longest
        padding += 0 if at & (at - 1) == 0 else longest - at
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        want, at = np.array([*ids(text), 1], "<u4"), 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(want[at : at + p.length].tobytes())
            at += p.length
        assert at == len(want)
    return padding, len(by_seq)


def test_packing(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    padding, n = check_pieces(packing.op8_packing(spark, sf).collect(), docs, plain("byte_bpe_50k.json"))
    assert padding <= 2048 * df.rdd.getNumPartitions()
    odd = [(k, t) for k, t in enumerate(ODD)]
    few = spark.createDataFrame([(*r, 1) for r in odd], "doc_id long, text string, tier int")
    check_pieces(packing.pack(few, public_tokenizers.path("byte_bpe_50k.json"), 1, pool=3).collect(), odd, plain("byte_bpe_50k.json"))
    assert packing.pack(few.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 1).count() == 0


def test_step_groups_hold_equally_many_tokens():
    packer, rng = packing.Packer(pool=64, group_tokens=4096), np.random.default_rng(2)
    pieces = [p for k in range(500) for p in packer.add(k, np.zeros(rng.integers(1, 5000), np.uint16))] + list(packer.finish())
    groups = {}
    for p in pieces:
        groups.setdefault((p[6], p[7]), 0)
        groups[p[6], p[7]] += len(p[2])
    full = [v for v in groups.values() if v == 4096]
    assert len(full) >= len(groups) - 5

import hashlib
import random

import oracle
import pyarrow as pa
import pytest

from quillspark.llm import warc as w

SHA = lambda b: hashlib.sha256(b).hexdigest()


def made(n=8, packed=True):
    parts = []
    for k in range(n):
        body = f"<p>page {k} {random.Random(k).random()} WARC/1.1\r\n</p>".encode() * (k * 50 + 1)
        r = w.record(k, f"http://x/{k}", body, SHA(body), None, "2000-01-01T00:00:00Z")
        parts.append(w.member(r) if packed else r)
    return parts


def read(data):
    return list(w.salvage(pa.BufferReader(data)))


@pytest.mark.parametrize("packed", [True, False])
def test_whole_file(packed):
    got = read(b"".join(made(packed=packed)))
    assert [x[0] for x in got] == ["record"] * 8
    assert [int(x[1]["x-page-id"]) for x in got] == list(range(8))


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("harm", ["flip", "cut", "junk", "head", "end", "lost"])
def test_damage_costs_only_the_damaged_record(packed, harm):
    parts = made(packed=packed)
    k = 3
    p, lost = parts[k], {k}
    if harm == "flip":
        at = len(p) // 2
        parts[k] = p[:at] + bytes([p[at] ^ 0x55]) + p[at + 1 :]
    elif harm == "cut":
        parts[k] = p[: len(p) // 2]
    elif harm == "junk":
        parts[k] = p + bytes(random.Random(1).randbytes(5000))
        lost = set()
    elif harm == "head":
        parts[k] = b"\0" * 12 + p[12:]
    elif harm == "end":
        k = 7
        parts[k], lost = parts[k][:-9], set() if packed else {7}  # a packed record is whole before its checksum
    else:
        parts[k] = b""
    data = b"".join(parts)
    got = read(data)
    assert {int(x[1]["x-page-id"]) for x in got if x[0] == "record"} == set(range(8)) - lost
    gaps = [x for x in got if x[0] == "gap"]
    assert len(gaps) == (0 if harm == "lost" else 1)
    begin = sum(map(len, parts[:k]))
    for _, a, b, reason in gaps:
        assert reason and begin <= a < b <= begin + len(parts[k])


def pages_of(got):
    return [int(x[1]["x-page-id"]) for x in got if x[0] == "record"]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("harm", ["head", "junk"])
def test_damage_at_the_start_costs_only_the_first_record(packed, harm):
    parts = made(packed=packed)
    first = parts[0]
    parts[0] = b"\0" * 12 + first[12:] if harm == "head" else b"junk \x1f\x8b\x08 WARC/1.1\r\n" + first
    got = read(b"".join(parts))
    lost = {0} if harm == "head" else set()
    assert pages_of(got) == [k for k in range(8) if k not in lost]
    assert [x[1] for x in got if x[0] == "gap"] == [0]


@pytest.mark.parametrize("first", [0, 1])
@pytest.mark.parametrize("between", [b"", b"junk" * 50])
def test_mixed_files(first, between):
    packed, plain = made(), made(packed=False)
    got = read(between.join((packed if k % 2 == first else plain)[k] for k in range(8)))
    assert pages_of(got) == list(range(8))
    assert len([x for x in got if x[0] == "gap"]) == (7 if between else 0)


def test_gap_within_a_member_names_the_lost_bytes():
    one, two, three = made(3, False)
    got = read(w.member(one + b"x" * 30 + two + two[:50]) + w.member(three))
    assert pages_of(got) == [0, 1, 2]
    assert [x[3].split(", ")[-1] for x in got if x[0] == "gap"] == [f"bytes {len(one)} to {len(one) + 30} of the unpacked member", f"bytes {len(one + two) + 30} to {len(one + two) + 80} of the unpacked member"]


def whole_archive(n=50, size=4000, level=4):
    rng = random.Random(n)
    out = []
    for k in range(n):
        body = "".join(rng.choices("abcdefgh <>/", k=size)).encode()
        out.append(w.record(k, f"http://x/{k}", body, SHA(body), None, "2000-01-01T00:00:00Z"))
    return out


@pytest.mark.parametrize("harm", ["cut", "flip", "checksum", "early"])
@pytest.mark.parametrize("size", [300, 4000, 40_000])
def test_sound_records_of_a_damaged_member(harm, size):
    """Many records in one member: those before the damage come back, and what follows the member too."""
    packed, after = bytearray(w.member(b"".join(whole_archive(size=size)))), w.member(whole_archive(51)[50])
    if harm == "cut":
        packed = packed[: len(packed) * 8 // 10]
    elif harm == "checksum":
        packed[-6] ^= 0x10
    else:
        packed[len(packed) * (8 if harm == "flip" else 3) // 10] ^= 0x55
    got = read(bytes(packed) + after)
    blocks = [w.parse(r)[1] for r in whole_archive(size=size)] + [w.parse(whole_archive(51)[50])[1]]
    found = [blocks.index(x[2]) for x in got if x[0] == "record"]
    least = {"cut": 38, "flip": 38, "checksum": 50, "early": 13}[harm]
    assert found == sorted(set(found)) and found[:least] == list(range(least)) and found[-1] == 50
    assert got[-2][0] == "gap" and got[-2][2] == len(packed) and all(x[1] < x[2] <= len(packed) for x in got if x[0] == "gap")


def test_without_digests_only_sound_members_are_believed():
    parts = [r.replace(b"WARC-Block-Digest: ", b"X-Other: ") for r in whole_archive(20)]
    packed = w.member(b"".join(parts))
    assert pages_of(read(packed)) == list(range(20))
    assert pages_of(read(packed[: len(packed) // 2])) == list(range(9))
    harmed = bytearray(packed)
    harmed[-6] ^= 1
    assert pages_of(read(bytes(harmed) + w.member(whole_archive(21)[20]))) == [20]


def test_records_stored_in_a_damaged_member_come_once():
    import zlib

    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    packed = bytearray(c.compress(b"".join(whole_archive(6, 500))) + c.flush())
    packed[-6] ^= 1
    assert pages_of(read(bytes(packed))) == list(range(6))


class Counting:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.data, self.most, self.all = data, 0, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.most, self.all = max(self.most, n), self.all + n
        return self.data[at : at + n]


@pytest.mark.parametrize("wrong", [b"9" * 12, b"30000000"])
def test_a_wrong_length_is_not_believed_beyond_itself(wrong):
    parts = whole_archive(200, 20_000)
    parts[3] = parts[3].replace(b"\r\nContent-Length: 20", b"\r\nContent-Length: " + wrong, 1)
    source = Counting(b"".join(parts) * 8)  # 32 MB
    got = list(w.salvage(source))
    assert len(pages_of(got)) == 199 * 8
    assert source.most <= (30_000_000 if wrong[0] == ord("3") else 0) + w.HEAD
    assert source.all < 3 * len(source.data) + 8 * source.most


def test_whole_reads_take_each_byte_about_once():
    source = Counting(b"".join(w.member(r) for r in whole_archive(400)))
    assert len(list(w.salvage(source))) == 400
    assert source.all <= 2 * len(source.data)


def test_empty_and_strange_files():
    assert read(b"") == []
    assert [x[0] for x in read(b"no archive at all" * 1000)] == ["gap"]
    assert [x[0] for x in read(w.member(b"no record"))] == ["gap"]


ROWS = [
    (5, "http://a", "x" * 99),
    (6, "http://b", "x" * 99),
    (9, "http://c", "é" * 50),
    (7, None, "é" * 50),
    (7, "http://again", "é" * 50),
    (8, "http://d e\n", None),
    (10, "", ""),
    (None, "http://e", "é" * 50),
    (11, "http://f", "long " * 400_000),
    (12, "http://f", "long " * 400_000),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "q") for r in ROWS], "page_id long, url string, html string, digest string")
    got = sorted(map(tuple, w.warc_round_trip(pages).collect()), key=repr)
    want = []
    for page, _, html in ROWS:
        b = (html or "").encode()
        first = min(p for p, _, h in ROWS if (h or "").encode() == b and p is not None)
        again = len(b) >= 100 and page != first
        want.append((page, len(b), SHA(b), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    assert w.warc_round_trip(pages.limit(0)).count() == 0


def test_oracle(spark, sf):
    oracle.same(w.op9_warc(spark, sf), w.ORACLES["op9_warc"], oracle.connect(sf))

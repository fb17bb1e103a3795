"""Numbers on a bound or on half of a printed place have the last bit that SQL gives them."""

import math
import random

import duckdb
from oracle import connect, same

from quillspark.functions.packs import LATIN
from quillspark.functions.thresholds import RULE_DIMENSIONS
from quillspark.operators import semantic as V
from quillspark.operators.kernels import Kernel
from quillspark.plans import registry


def _cases(signs: str, seed: int, many: int) -> list[str]:
    """Texts of which the entropy is a fraction though not all shares are powers of a half."""
    draw, out = random.Random(seed), []
    while len(out) < many:
        counts = [draw.choice([1, 2, 3, 4, 6, 9, 12, 18]) for _ in range(draw.randint(3, len(signs)))]
        n, product = sum(counts), math.prod(c**c for c in counts)
        top = n**n // math.gcd(n**n, product)
        if 15 <= n <= 72 and n & (n - 1) and product * top % n**n == 0 and top & (top - 1) == 0 and (rest := product * top // n**n) & (rest - 1) == 0:
            own = draw.sample(signs, len(counts))
            text = [c for c, k in zip(own, counts, strict=True) for _ in range(k)]
            draw.shuffle(text)
            out.append("".join(text))
    return out


def test_entropies_that_are_fractions_have_the_bits_of_sql():
    con, kernel = duckdb.connect(), Kernel(LATIN)
    for text in ["***Éaiaielle***ment***an", *_cases("abcdefghiklmnoprstéüÄ中文😀", 1, 150)]:
        assert kernel.sentence_values(text)[1] == con.execute("SELECT list_aggregate(string_split(?, ''), 'entropy')", [text]).fetchone()[0], text
    at = [d[0] for d in RULE_DIMENSIONS].index("punctuation_entropy")
    for text in _cases(",.;:!?()", 2, 60):
        assert kernel.values(text, None)[at] == con.execute("SELECT list_aggregate(string_split(?, ''), 'entropy')", [text]).fetchone()[0], text


def _documents(spark, path, lines) -> str:
    spark.createDataFrame([(k, t, "en", "made", len(t)) for k, t in enumerate(lines)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_reasons_print_halves_as_sql_does(spark, tmp_path):
    """Perplexities of x.x5, from a word that stands so often in the first half and alone in the second, and entropies of 2.25, 2.75 and the like."""
    lines = ["*** Éaiaielle*** ment*** an", *_cases("abcdefghik", 3, 60)]
    for half in range(10, 41):
        for often in range(1, half):
            if half * 20 % often == 0 and half * 20 // often % 2 == 1 and half / often < 12:
                lines.append(" ".join(["word"] * often + [f"x{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(half - often)] + ["word"] * half))
    d = _documents(spark, tmp_path, lines)
    same(registry.QUERIES["sentence_reasons"](spark, d), registry.ORACLES["sentence_reasons"], connect(d))


def test_likeness_to_a_pool_is_added_up_plainly(spark):
    """Of short texts two or three entries meet, whose sum is the same in any order if each product is rounded, as in SQL; a matrix product need not round them."""
    kernel, draw = Kernel(LATIN), random.Random(7)
    words = ["a", "at", "one", "stone", "letter", "paper", "river", "is", "the"]
    rows, refs = ([" ".join(draw.choices(words, k=draw.randint(1, 9))) for _ in range(n)] for n in (400, 60))
    vectors = {t: kernel.vector(t) for t in {*rows, *refs}}
    df = spark.createDataFrame([(k, vectors[t]) for k, t in enumerate(rows)], "id int, vec array<double>")
    pool = spark.createDataFrame([(vectors[t],) for t in refs], "ref array<double>")

    def plain(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    want = [max(plain(vectors[t], vectors[r]) for r in refs) for t in rows]
    for block in (500, 10):  # all to every task, and by cells
        assert [r.similarity for r in V.pool_similarity(df, pool, ["id"], block=block).orderBy("id").collect()] == want, block


def test_words_on_a_line_have_the_zones_of_sql(spark, tmp_path):
    """Turns whose words stand as often as 1/rank tells: 1 - R squared is 0 but for its last bits, whose sign decides between the human zone, which begins at 0, and gray."""
    words, turns = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"], []
    for kinds in (3, 4, 6):
        for many in range(1, 9):
            counts = [math.lcm(*range(1, kinds + 1)) * many // r for r in range(1, kinds + 1)]
            if sum(counts) >= 20:
                turns.append(" ".join(w for w, c in zip(words, counts) for _ in range(c)))
    path = tmp_path / "data"
    spark.createDataFrame([(k // 4, k % 4, "user", t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    same(registry.QUERIES["fused_json"](spark, str(path)), registry.ORACLES["fused_json"], connect(path))

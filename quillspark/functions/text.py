"""Column functions on texts and arrays: all native, none moves rows."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .phrases import FEW, book

#: White space that strip() removes, written out: the engines' own classes differ.
SPACE = " \\t\\r\\n\\x0B\\f\\u00A0\\u3000"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def words_array(phrases: Iterable[str]) -> Column:
    """A literal array, empty without phrases."""
    own = [F.lit(p) for p in phrases]
    return F.array(*own) if own else F.array().cast("array<string>")


def hits(text: Column, phrases: Iterable[str]) -> Column:
    """How many of the distinct phrases occur: a search for each, or where there are many one automaton for all."""
    phrases = tuple(dict.fromkeys(phrases))
    if len(phrases) > FEW:

        def run(texts: pd.Series) -> pd.Series:
            own = book(phrases)
            return pd.Series([own.present(t) for t in texts], index=texts.index, dtype="int32")

        return F.pandas_udf(run, "int")(text)
    return F.size(F.filter(words_array(phrases), lambda p: F.contains(text, p)))


def deviation(numbers: Column) -> Column:
    """Population standard deviation of an array's numbers, by Welford's recurrence in their order: the same last bit as SQL has, which decides at bounds."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))

    def step(a: Column, x: Column) -> Column:
        mean = a.mean + (x - a.mean) / (a.n + 1)
        return F.struct((a.n + 1).alias("n"), mean.alias("mean"), (a.square + (x - mean) * (x - a.mean)).alias("square"))

    return F.aggregate(numbers, start, step, lambda a: F.sqrt(a.square / a.n))


def nearest(number: Column, places: int) -> Column:
    """A number to so many places as SQL rounds it: the product with a power of ten to the nearest whole number. The engine's own round() goes by the shortest decimal form instead, which differs near halves."""
    power = F.lit(10.0**places)
    return F.round(number * power) / power


def fixed(number: Column, places: int) -> Column:
    """A number of up to three places as printf writes it: by its exact binary value, halves to even. Integers are exact in the product, as each part has half the bits."""
    power, whole = F.lit(10.0**places), number.cast("float").cast("double")
    high = whole * power
    near = F.rint(high)
    rest, odd = (number - whole) * power, F.pmod(near, F.lit(2.0)) != 0
    above, below = 0.5 - (high - near), -0.5 - (high - near)
    up = (rest > above) | ((rest == above) & odd)
    down = (rest < below) | ((rest == below) & odd)
    return F.format_string(f"%.{places}f", (near + F.when(up, 1.0).when(down, -1.0).otherwise(0.0)) / power)


def run_starts(ordered: Column) -> Column:
    """Positions, from 1, at which a new value begins. `ordered` must be a column of its own, or it is computed for each element."""
    n = F.size(ordered)
    new = lambda i: (i == 1) | (F.element_at(ordered, i) != F.element_at(ordered, F.greatest(i - 1, F.lit(1))))
    return F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), new)).otherwise(F.array().cast("array<int>"))


def run_lengths(starts: Column, n: Column) -> Column:
    """How often each value stands, from the starts of its runs."""
    ends = F.when(F.size(starts) > 0, F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n + 1)))
    return F.coalesce(F.zip_with(starts, ends, lambda a, b: b - a), F.array().cast("array<int>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

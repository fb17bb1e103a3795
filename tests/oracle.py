"""Compare a query with its SQL in DuckDB, as unordered rows with columns by name."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'" if p.is_file() else f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    return con


def _norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(names, data) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


def same(df, sql: str, con) -> None:
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows(names, res.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, (len(bad), bad[:3])

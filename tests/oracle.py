"""Compare a query with its SQL on one set of tables."""

from __future__ import annotations

import math
import pathlib

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = pathlib.Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows(frame_rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in frame_rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)), [names[i] for i in order]


def mismatch(df, sql: str, con) -> str | None:
    ours, names = rows([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    theirs, other = rows(result.fetchall(), [c[0] for c in result.description])
    if names != other:
        return f"columns {names} / {other}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ, such as {bad[:2]}" if bad else None

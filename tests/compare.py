"""Spark rows against DuckDB rows: same names, same multiset of values."""

import math
from collections import Counter
from pathlib import Path


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "inf" if math.isinf(v) else f"{v:.6g}" if v else "0"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, dict):
        return str({k: norm(x) for k, x in v.items()})
    return str(v)


def duck(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def differences(spark, query, sql, sf_dir):
    """An empty string where both agree, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = Counter(tuple(norm(v) for v in r) for r in df.select(*names).collect())
    cols, rows = duck(sf_dir, sql)
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    order = [cols.index(n) for n in names]
    theirs = Counter(tuple(norm(r[i]) for i in order) for r in rows)
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only Spark {list((mine - theirs).items())[:3]}; only SQL {list((theirs - mine).items())[:3]}; of {names}"

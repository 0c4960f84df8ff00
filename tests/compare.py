"""Runs a query and its SQL on the same tables and compares them as the driver does."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()


def shown(v) -> str:
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(int(v)) if type(v).__name__.startswith(("int", "uint")) and abs(int(v)) >= 10**6 else f"{v:.6g}" if type(v).__name__.startswith(("int", "uint")) else str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(shown(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))

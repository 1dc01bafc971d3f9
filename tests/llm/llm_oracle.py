"""Comparing a query with its SQL on the driver's tables, in no order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if v is None or v != v:
        return None
    return float(v) if isinstance(v, float) else v


def assert_equal(spark, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert columns == sorted(names)
    own = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    other = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert own == other

"""Compare a query's rows with those of its SQL in DuckDB."""

import decimal
import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def connect(folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def differences(df, connection, sql):
    """Rows that only one side has, as two counters; raises where the columns differ."""
    relation = connection.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [list(relation.columns).index(c) for c in columns]
    a = Counter(str([plain(r[c]) for c in columns]) for r in df.collect())
    b = Counter(str([plain(r[i]) for i in at]) for r in relation.fetchall())
    return a - b, b - a

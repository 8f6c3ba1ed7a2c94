"""Comparing a query with its SQL on the same tables."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return round(float(v), 4) + 0.0
    return v


def rows(frame):
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=repr)


def check(spark, name, query, sql, sf_dir):
    ours = query(spark, sf_dir).toPandas()
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    theirs = db.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns), name
    assert len(ours) == len(theirs), name
    differing = [x for x in zip(rows(ours), rows(theirs), strict=True) if x[0] != x[1]]
    assert not differing, (name, differing[:3])

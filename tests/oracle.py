"""Compare a Spark result with what DuckDB makes of the oracle's SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return db


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if isinstance(v, float) and v == v and v == int(v):
            return str(int(v))
        return "" if pd.isna(v) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def same(spark_df, db, sql: str) -> None:
    got, want = spark_df.toPandas(), db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

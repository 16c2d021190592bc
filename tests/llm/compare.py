"""A query beside its SQL on a small folder."""

import duckdb
from pyspark.sql import functions as F

from proseaudit.llm import queries


def against_sql(spark, name, folder="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(queries.SQL[name]).fetch_df()
    got = queries.QUERIES[name](spark, folder).select(*[F.col(c) for c in want.columns]).toPandas()
    key = list(want.columns)
    a, b = (sorted(map(tuple, x[key].astype(str).values.tolist())) for x in (want, got))
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]

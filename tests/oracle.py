"""Compares queries with their SQL, as the driver does: rows, columns and values, in any order."""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differs(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return f"{len(mine[1])} and {len(theirs[1])} rows; only ours {sorted(a - b, key=repr)[:3]}; only in SQL {sorted(b - a, key=repr)[:3]}"
    return f"no rows" if not mine[1] else ""


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf = sys.argv[1]
    con, queries, sqls = connect(sf), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sqls:
        t = time.time()
        try:
            said = differs(spark, con, sf, queries[name], sqls[name])
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{'ok ' if not said else 'BAD'} {name} {time.time() - t:.1f}s {said[:900]}", flush=True)

"""Run registered queries on Spark and their SQL on DuckDB and compare all values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows),
                  key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark_df, con, sql: str, tolerance: float = 0.0) -> str | None:
    """None if equal, else what differs first."""
    found = [tuple(r) for r in spark_df.collect()]
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    wanted = result.fetchall()
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    if len(found) != len(wanted):
        return f"{len(found)} rows != {len(wanted)}"
    for a, b in zip(_rows(spark_df.columns, found), _rows(columns, wanted)):
        for x, y in zip(a, b):
            if type(x) is not type(y):
                return f"types {a} != {b}"
            same = x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=0, abs_tol=tolerance))
            if not same:
                return f"{a} != {b}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            problem = difference(df, con, oracle[name]) if name in oracle else None
            note = f"{df.count()} rows" if name not in oracle else ""
        except Exception as error:
            problem, note = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok'} {name} {time.time() - start:.1f}s {note} {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

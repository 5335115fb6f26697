"""Compares registered queries with their SQL twins, as the driver does: names, types, rows, values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    """Rows in a fixed order with columns by name; missing values and dates as one form."""
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False, name=None):
        values = []
        for v in row:
            if pd.isna(v):
                values.append(None)
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                values.append(bool(v))
            elif hasattr(v, "isoformat"):
                values.append(pd.Timestamp(v).isoformat())
            elif isinstance(v, str):
                values.append(v)
            else:
                values.append(float(v))
        out.append(tuple(values))
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def type_differences(spark_df, con, sql: str) -> list[str]:
    """Columns whose types are not the same in both."""
    theirs = {d[0]: str(d[1]) for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}
    return [f"{c}: {t} / {theirs.get(c)}" for c, t in spark_df.dtypes if TYPES.get(t, t) != theirs.get(c)]


def difference(spark_df, con, sql: str) -> str | None:
    """None if both give the same, else what differs."""
    types = type_differences(spark_df, con, sql)
    if types:
        return f"types {types}"
    left, right = spark_df.toPandas(), con.execute(sql).df()
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = normal(left), normal(right)
    for x, y in zip(a, b):
        if x != y:
            return f"{x} / {y}"[:600]
    return None


def main() -> None:
    from registry.oracles import ORACLES
    from registry.queries import QUERIES
    from tests.conftest import session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark: SparkSession = session()
    con = duck(sf_dir)
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            problem = difference(df, con, ORACLES[name]) if name in ORACLES else f"rows only: {df.count()}"
        except Exception as error:  # report and go on
            problem = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None and not problem.startswith("rows only")
        print(f"{name:32s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print("without twin:", sorted(set(QUERIES) - set(ORACLES)), "unknown twins:", sorted(set(ORACLES) - set(QUERIES)))
    print("different:", bad)


if __name__ == "__main__":
    main()

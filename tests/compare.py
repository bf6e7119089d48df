"""Run a registered query and its checking SQL side by side.

    python tests/compare.py 0.01 [name …]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "decimal(4,1)": "DECIMAL(4,1)"}


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(frame: pd.DataFrame) -> list[tuple]:
    def cell(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return ""
        if isinstance(value, pd.Timestamp):
            return value.isoformat()
        if hasattr(value, "isoformat"):
            return pd.Timestamp(value).isoformat()
        if isinstance(value, float):
            return repr(value + 0.0)
        return str(value)

    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def differences(df, con, sql: str) -> list[str]:
    """What differs between the Spark result and the SQL result; empty when they agree."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    described = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    problems = []
    if set(types) != set(described):
        return [f"columns {sorted(set(types) ^ set(described))}"]
    for name, kind in types.items():
        if KIND.get(kind, kind) != described[name]:
            problems.append(f"type of {name}: {kind} / {described[name]}")
    names = sorted(types)
    mine = [tuple(row) for row in df.select(*names).collect()]
    theirs = con.execute(f"SELECT {', '.join(names)} FROM ({sql}) q").fetchall()
    left = _plain(pd.DataFrame(mine, columns=names, dtype=object))
    right = _plain(pd.DataFrame(theirs, columns=names, dtype=object))
    if len(left) != len(right):
        problems.append(f"rows {len(left)} / {len(right)}")
    if left != right:
        bad = {}
        for a, b in zip(left, right):
            for name, x, y in zip(names, a, b):
                if x != y:
                    bad.setdefault(name, (x, y))
        problems.append(f"values {bad}")
    if not left:
        problems.append("no rows")
    return problems


def main() -> None:
    import __spark_entry__ as entry
    from havenlens.session import build_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    queries, checks = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(checks)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name in names:
        started = time.time()
        try:
            problems = differences(queries[name](spark, folder), con, checks[name])
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{name:32s} {time.time() - started:6.1f}s {'ok' if not problems else problems}", flush=True)
        if problems:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; differing: {failed}")


if __name__ == "__main__":
    main()

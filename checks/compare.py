"""Run queries and their SQL side by side: ``python -m checks.compare SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracle import ORACLE
from checks.queries import QUERIES
from corpuslens.plans.session import local_session

TABLES = "conversations documents labels benchmark embeddings".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def comparable(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)]
    return sorted(rows, key=lambda row: [(v is not None, str(v)) for v in row])


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> list[str]:
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"]
    a, b = comparable(ours), comparable(theirs)
    found = [] if len(a) == len(b) else [f"{len(a)} rows against {len(b)}"]
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    for name, rows in (("spark", only_a), ("sql", only_b)):
        found += [f"only {name}: {row}" for row in sorted(rows, key=str)[:3]]
    if found and (only_a or only_b):
        found.append(f"{len(only_a)} and {len(only_b)} rows differ")
    return found


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, connection = local_session(), connect(sf_dir)
    for name in names:
        start = time.time()
        ours = QUERIES[name](spark, sf_dir).toPandas()
        middle = time.time()
        if name not in ORACLE:
            print(f"{name:24s} rows {len(ours)} in {middle - start:.1f} s, no SQL", flush=True)
            continue
        found = differences(ours, connection.execute(ORACLE[name]).df())
        verdict = "ok  " if not found else "DIFF"
        print(
            f"{name:24s} {verdict} rows {len(ours)}, spark {middle - start:.1f} s, "
            f"sql {time.time() - middle:.1f} s",
            *[line[:400] for line in found], sep="\n    " if found else " ", flush=True,
        )


if __name__ == "__main__":
    main()

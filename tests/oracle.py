"""Compare a query's rows with its DuckDB SQL, without order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(frame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)

    def plain(x):
        if x is None or pd.isna(x):
            return None
        return str(int(x) if float(x).is_integer() else round(float(x), 6)) if isinstance(x, float) else str(int(x)) if isinstance(x, (bool, np.bool_)) else str(x)

    return columns, sorted([tuple(map(plain, row)) for row in frame[columns].astype(object).itertuples(index=False)], key=repr)


def difference(found, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both hold the same rows."""
    (names, mine), (other_names, theirs) = _rows(found.toPandas()), _rows(con.execute(sql).df())
    if names != other_names:
        return f"columns {names} and {other_names}"
    if mine == theirs:
        return ""
    a, b = set(mine), set(theirs)
    return f"{len(mine)} and {len(theirs)} rows; only here {sorted(a - b, key=repr)[:3]}; only there {sorted(b - a, key=repr)[:3]}"

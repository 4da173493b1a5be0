"""Run a registered query and its SQL, and compare names, types and values."""

from __future__ import annotations

import math
import os

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(
                f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
            )
    return con


def _plain(table: pa.Table) -> tuple[dict, list]:
    names = sorted(table.column_names)
    types = {n: str(table.schema.field(n).type).replace("large_", "") for n in names}
    columns = [table.column(n).to_pylist() for n in names]
    # -0.0 and 0.0 are one value; everything else must match exactly.
    rows = [
        tuple(0.0 if isinstance(v, float) and v == 0.0 else v for v in row)
        for row in zip(*columns)
    ]
    return types, sorted(rows, key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    mine = _plain(spark_df.toArrow())
    theirs = _plain(con.sql(sql).to_arrow_table())
    found = []
    if mine[0] != theirs[0]:
        found.append(f"types: {set(mine[0].items()) ^ set(theirs[0].items())}")
    if len(mine[1]) != len(theirs[1]):
        found.append(f"rows: {len(mine[1])} != {len(theirs[1])}")
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1]) if not _same(a, b)]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {wrong[0]}")
    return found


def _same(a: tuple, b: tuple) -> bool:
    return len(a) == len(b) and all(
        x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
        for x, y in zip(a, b)
    )

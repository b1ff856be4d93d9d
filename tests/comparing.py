"""Compare a Spark result with the checking SQL's result, row by row and order-free."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def open_database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple], dict[str, str]]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    return columns, result.fetchall(), kinds


def rows_of_spark(df) -> tuple[list[str], list[tuple], dict[str, str]]:
    return df.columns, [tuple(r) for r in df.collect()], dict(df.dtypes)


def in_order(columns: list[str], rows: list[tuple]) -> list[tuple]:
    places = [columns.index(c) for c in sorted(columns)]
    picked = [tuple(r[i] for i in places) for r in rows]
    return sorted(picked, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark_side, sql_side) -> str | None:
    columns, rows, kinds = spark_side
    sql_columns, sql_rows, sql_kinds = sql_side
    if sorted(columns) != sorted(sql_columns):
        return f"columns {sorted(set(columns) ^ set(sql_columns))}"
    family = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    }
    wrong = {c: (kinds[c], sql_kinds[c]) for c in columns if family.get(kinds[c]) != sql_kinds[c]}
    if len(rows) != len(sql_rows):
        return f"rows {len(rows)} against {len(sql_rows)}"
    ours, theirs = in_order(columns, rows), in_order(sql_columns, sql_rows)
    for mine, other in zip(ours, theirs):
        if mine != other:
            names = sorted(columns)
            return "values " + str([(n, a, b) for n, a, b in zip(names, mine, other) if a != b][:6]) + f" in {mine[:4]}"
    return f"types {wrong}" if wrong else None

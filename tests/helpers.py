"""Comparison of a query's rows with its SQL on DuckDB."""

from pathlib import Path

import duckdb


def compare(spark, folder, query, sql):
    got = query(spark, folder).toArrow()
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    con.register("got", got)
    con.execute(f"CREATE TABLE want AS {sql}")
    columns = sorted(r[0] for r in con.execute("DESCRIBE want").fetchall())
    assert columns == sorted(got.column_names)
    listed = ", ".join(f'"{c}"' for c in columns)
    for one, other in (("want", "got"), ("got", "want")):
        assert con.execute(f"SELECT {listed} FROM {one} EXCEPT ALL SELECT {listed} FROM {other} LIMIT 5").fetchall() == [], one

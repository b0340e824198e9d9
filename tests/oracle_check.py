"""Compare a Spark query with its SQL oracle: schema, row count, values."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _canon(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (1, repr(round(value, 9)))
    return (1, str(value))


def _rows(table):
    names = sorted(table.column_names)
    columns = [[_canon(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns, strict=True)) if columns else []


def _kind(arrow_type) -> str:
    text = str(arrow_type)
    for old, new in (("large_string", "string"), ("timestamp[ns]", "timestamp[us]"), ("int32", "int"), ("int64", "int")):
        text = text.replace(old, new)
    return text


def compare(df, con, sql: str) -> tuple[int, list[str]]:
    """Number of rows and the list of differences (empty when equal)."""
    got = df.toArrow()
    want = con.sql(sql).to_arrow_table()
    problems = []
    left = {f.name: _kind(f.type) for f in got.schema}
    right = {f.name: _kind(f.type) for f in want.schema}
    if left != right:
        diff = {k: (left.get(k), right.get(k)) for k in left.keys() | right.keys() if left.get(k) != right.get(k)}
        problems.append(f"schema {diff}")
    if got.num_rows != want.num_rows:
        problems.append(f"rows {got.num_rows} != {want.num_rows}")
    if set(left) == set(right):
        a, b = _rows(got), _rows(want)
        if a != b:
            only_a = [r for r in a if r not in set(b)][:2]
            only_b = [r for r in b if r not in set(a)][:2]
            problems.append(f"values {sorted(left)}\n  spark  {str(only_a)[:700]}\n  oracle {str(only_b)[:700]}")
    return got.num_rows, problems

"""Run a registered query and its SQL on the same tables and compare the rows."""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f'CREATE VIEW "{name}" AS SELECT * FROM \'{path}\'')
    return con


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "item"):
        return cell(v.item())
    if isinstance(v, int):
        return repr(v)
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp", "HUGEINT": "decimal", "FLOAT": "float"}


def compare(spark, con, name, fn, sql, sf_dir):
    """(problem or None, spark seconds, sql seconds, rows)"""
    t = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    took = time.time() - t
    if sql is None:
        return None, took, 0.0, len(rows)
    t = time.time()
    cur = con.execute(sql)
    want = cur.fetchall()
    sql_took = time.time() - t
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", took, sql_took, len(rows)
    kinds = {c[0]: TYPES.get(str(c[1]), str(c[1])) for c in cur.description}
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types = {c: (mine[c], kinds[c]) for c in names if mine[c] != kinds[c]}
    a, b = canonical(df.columns, rows), canonical(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", took, sql_took, len(rows)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}", took, sql_took, len(rows)
    return (f"types {types}" if types else None), took, sql_took, len(rows)


def main(argv):
    import __spark_entry__ as entry
    from sparselens.session import build_session
    sf_dir = f"/root/testdata/{argv[0]}"
    wanted = argv[1:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            problem, took, sql_took, n = compare(spark, con, name, fn, entry.oracle_sql().get(name), sf_dir)
        except Exception as e:  # report and go on
            problem, took, sql_took, n = f"{type(e).__name__}: {str(e)[:600]}", 0, 0, 0
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name:34s} rows={n:<7d} spark={took:6.2f}s sql={sql_took:5.2f}s {problem or ''}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main(sys.argv[1:])

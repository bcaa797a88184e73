"""Compare registered queries with their SQL, value by value."""

import glob
import math
import os
import sys
import tempfile
import time

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_cell(r[i]) for i in order)) for r in rows)


def difference(df, con, sql):
    """None when both give the same columns and rows."""
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    wanted = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(columns)}"
    if found == wanted:
        return None
    a, b = set(found), set(wanted)
    return (
        f"{len(found)} rows instead of {len(wanted)}\n  got  {sorted(a - b)[:3]}\n  want {sorted(b - a)[:3]}"
    )


if __name__ == "__main__":
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = root
    import __spark_entry__ as entry
    from skuloom.session import build_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:]
    session = build_session(
        "oracle",
        **{
            "spark.master": "local[8]",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": f"file:{tempfile.mkdtemp(prefix='skuloom-oracle-')}",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, function in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            df = function(session, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s", problem or "", flush=True)
    print("failed:", failed)

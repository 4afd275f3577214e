"""Runs registered queries and their SQL side by side: python tests/parity.py [sf_dir] [name ...]"""

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.date | datetime.datetime):
        return str(v)
    return v


def compare(spark, sf_dir, name, run, sql):
    """An empty string if the results agree, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    own = run(spark, sf_dir)
    cols = sorted(own.columns)
    mine = sorted((tuple(_plain(v) for v in r) for r in own.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    other = sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if len(mine) != len(other):
        return f"{len(mine)} rows against {len(other)}; {[x for x in mine if x not in set(other)][:2]} {[x for x in other if x not in set(mine)][:2]}"
    bad = [(a, b) for a, b in zip(mine, other, strict=True) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ: {bad[:2]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from gridmill.plans.session import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
    spark.sparkContext.setLogLevel("ERROR")
    sqls = entry.oracle_sql()
    for name, run in entry.queries().items():
        if (sys.argv[2:] and name not in sys.argv[2:]) or name not in sqls:
            continue
        start = time.time()
        try:
            said = compare(spark, sf, name, run, sqls[name]) or "same"
        except Exception as error:
            said = f"ERROR {str(error)[:600]}"
        print(f"{name:28} {time.time() - start:5.1f} s  {said}", flush=True)

"""Runs registered queries against their SQL on the same tables.

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("factweave")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float,)):
        if math.isnan(value):
            return None
        return repr(float(value))
    if isinstance(value, int):
        return str(value)
    if hasattr(value, "item"):
        return norm(value.item())
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(norm(v)) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) or "\0" for i in order) for r in rows)


def compare(df, con, sql):
    started = time.time()
    got = df.collect()
    took = time.time() - started
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", took, len(got)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        types = {d[0]: str(d[1]) for d in res.description}
        odd = []
        for f in df.schema.fields:
            kind = f.dataType.simpleString()
            duck_kind = types[f.name]
            ok = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(kind)
            if ok != duck_kind:
                odd.append(f"{f.name}:{kind}/{duck_kind}")
        return True, ("types " + ",".join(odd)) if odd else "", took, len(got)
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    return False, f"rows {len(a)} vs {len(b)}\n   spark {only_a}\n   sql   {only_b}", took, len(got)


def main():
    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    names = sys.argv[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if names and name not in names and not any(n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        try:
            started = time.time()
            df = queries[name](spark, sf_dir)
            plan = time.time() - started
            if name in oracles:
                ok, note, took, n = compare(df, con, oracles[name])
            else:
                began = time.time()
                n = len(df.collect())
                ok, note, took = True, "no sql", time.time() - began
        except Exception as error:  # noqa: BLE001
            ok, note, took, n, plan = False, f"{type(error).__name__}: {str(error)[:1500]}", 0, 0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} rows={n:<8d} {plan:5.1f}+{took:5.1f}s {note}", flush=True)
    print("failed:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

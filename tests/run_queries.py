"""Run registered queries against their SQL: python tests/run_queries.py [sf_dir] [name ...]

SLICES=50 deals the ordered steps into 50 slices, however few rows there are.
"""

import os
import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]
from compare import check, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from webjourney.session import get_spark  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    conf = {"spark.sql.shuffle.partitions": "8"}
    if os.environ.get("SLICES"):
        conf |= {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": os.environ["SLICES"]}
    spark = get_spark("local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf), entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            if name in sqls:
                msg = check(spark, con, name, fn, sqls[name], sf)
            else:
                msg = f"rows only: {fn(spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"RESULT {name} {time.time() - t0:.1f}s {'OK' if msg is None else msg}", flush=True)

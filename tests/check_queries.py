"""Command-line check: python tests/check_queries.py [sf] [name part ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from harness import compare, duck  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from riskframe.plans import load_all  # noqa: E402


def main(argv):
    sf = argv[0] if argv else "0.01"
    path = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(path)
    con.execute("SET TimeZone='UTC'")
    qs, sqls = load_all()
    bad = 0
    for name, fn in qs.items():
        if argv[1:] and not any(p in name for p in argv[1:]):
            continue
        t = time.time()
        try:
            if name in sqls:
                ok, msg = compare(fn(spark, path), con, sqls[name])
            else:
                ok, msg = True, f"{fn(spark, path).count()} rows (no sql)"
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])

"""Compare queries with their SQL: python tests/check.py [sf] [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from codeloom.session import build_session
from tests.compare import compare, duck

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
names = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
con = duck(sf_dir)
queries, sqls = entry.queries(), entry.oracle_sql()
if names and names[0].startswith("@"):
    names = [n for n in queries if any(entry.module_of(n) == "codeloom.queries." + m for m in names[0][1:].split(","))]
bad = 0
for name in names or queries:
    t = time.time()
    try:
        n, problem = compare(spark, con, queries[name], sqls.get(name), sf_dir)
    except Exception as e:
        n, problem = -1, "".join(traceback.format_exception_only(e))[:1500]
    bad += problem is not None
    print(f"{'ok ' if problem is None else 'BAD'} {name:28s} {n:8d} rows {time.time()-t:6.2f}s {'' if name in sqls else '(no sql)'} {problem or ''}", flush=True)
print("bad:", bad)

"""python tests/check.py [name-prefix ...]: compare queries with their SQL twins."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry_module  # noqa: E402
from oracle import compare, connect  # noqa: E402
from tablewright.session import build_session  # noqa: E402

folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
queries, sqls = entry_module.queries(), entry_module.oracle_sql()
wanted = [q for q in queries if not sys.argv[1:] or any(q.startswith(p) for p in sys.argv[1:])]
bad = 0
for name in wanted:
    start = time.time()
    try:
        df = queries[name](spark, folder)
        if name in sqls:
            problems = compare(df, con, sqls[name])
            n = len(con.execute(sqls[name]).fetchall())
        else:
            n, problems = df.count(), []
    except Exception as exc:  # noqa: BLE001
        n, problems = -1, [f"{type(exc).__name__}: {str(exc)[:700]}"]
    bad += bool(problems)
    mark = "FAIL" if problems else ("ok" if name in sqls else "ok (no sql)")
    if problems or n == 0 or "-v" in os.environ.get("CHECK_FLAGS", "-v"):
        print(f"{mark:12} {name:36} rows={n} {time.time() - start:.1f}s {problems or ''}"[:1500], flush=True)
print(f"{len(wanted)} queries, {bad} failing")

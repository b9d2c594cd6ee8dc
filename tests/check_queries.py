"""Compare registered queries with DuckDB: ``python -m tests.check_queries SF [name part ...]``."""

import sys
import time
import traceback

import __spark_entry__ as entry_points
from tests.conftest import make_session
from tests.oracle import compare, duck


def main() -> int:
    path = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = make_session(), duck(path)
    queries, sqls = entry_points.queries(), entry_points.oracle_sql()
    failed = 0
    for name, build in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        begin = time.time()
        try:
            df = build(spark, path)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                note = ""
            else:
                problem, note = None, f" (no SQL, {df.count()} rows)"
        except Exception as e:  # noqa: BLE001
            problem, note = f"{type(e).__name__}: {str(e)[:600]}", ""
            if len(wanted) == 1:
                traceback.print_exc()
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - begin:.1f}s{note} {problem or ''}", flush=True)
    print(f"{failed} failed; {len(queries)} queries, {len(sqls)} with SQL")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())

"""Runs registered queries against their SQL: ``python tests/check.py <sf_dir> [name prefix ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from compare import connect, differences, oracle_rows, spark_rows  # noqa: E402

from panelwright.catalog import ORACLES, QUERIES  # noqa: E402
from panelwright.session import local_session  # noqa: E402


def main() -> int:
    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            t = time.time()
            got = spark_rows(fn(spark, sf))
            t1 = time.time() - t
            t = time.time()
            diff = differences(got, oracle_rows(con, ORACLES[name])) if name in ORACLES else None
            t2 = time.time() - t
            state = "rows" if name not in ORACLES else "ok" if diff is None else "DIFF"
            bad += diff is not None
            print(f"{state:5} {name} rows={len(got[0])} spark={t1:.1f}s duck={t2:.1f}s {diff or ''}"[:900], flush=True)
        except Exception as e:
            bad += 1
            msg = str(e).split("JVM stacktrace")[0]
            print(f"ERROR {name}: {type(e).__name__} {msg[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)

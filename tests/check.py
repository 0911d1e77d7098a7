"""``python tests/check.py [name-prefix ...]`` compares queries with oracles."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tests.conftest import make_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main():
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = make_session()
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 1 and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        try:
            if name in oracles:
                ok, message = compare(spark, sf_dir, fn, oracles[name], con)
            else:
                t0 = time.time()
                n = fn(spark, sf_dir).count()
                ok, message = n > 0, f"rows only: {n} in {time.time() - t0:.1f}s"
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + "  " + message, flush=True)
    print("failures:", bad)
    spark.stop()


main()

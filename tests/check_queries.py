"""Run registered queries against their oracles: python tests/check_queries.py [sf_dir] [prefix ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract
from tests.oracle import differences, duck
from tests.session import local_session


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con, failed = local_session(), duck(sf_dir), 0
    oracles = contract.oracle_sql()
    for name, run in contract.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        begin = time.time()
        try:
            df = run(spark, sf_dir)
            bad = differences(df, con, oracles[name]) if name in oracles else []
            note = "" if name in oracles else f"rows only: {df.count()}"
        except Exception as error:
            bad, note = [f"{type(error).__name__}: {str(error)[:600]}"], ""
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += bool(bad)
        print(f"{'BAD' if bad else 'ok '} {name:28s} {time.time() - begin:6.2f}s {note} {'; '.join(bad)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

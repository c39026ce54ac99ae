"""Time every query and compare it with its SQL, e.g.

    python -m tests.check_oracles /root/testdata/sf0.01 [name …]
"""

import sys
import time

import __spark_entry__ as entry
from shelf.session import local_session
from tests.oracle import connect, differences


def main(sf_dir, names):
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or sorted(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            result = differences(df, con, oracles[name]) if name in oracles else f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on
            result = f"{type(error).__name__}: {str(error)[:300]}"
        print(f"{time.time() - start:7.1f}s {name}: {result or 'ok'}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

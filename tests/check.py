"""python tests/check.py SF [name-prefix ...]: run queries against their SQL, print differences and times."""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

from compare import connect, difference  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from seqloom.catalog import ORACLES, QUERIES  # noqa: E402

if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1]}"
    names = [n for n in QUERIES if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLES:
                r = difference(df, con, ORACLES[name])
            else:
                r = None if (n := df.count()) else "no rows"
                name += f" (rows only: {n})"
        except Exception as e:
            r = "ERROR " + (str(e).strip() or repr(e))[:700]
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += r is not None
        print(f"{'ok ' if r is None else 'BAD'} {time.time() - t:6.2f}s {name} {r or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")

"""Skew stress run: the events readings replicated ``REPLICAS`` times (rows
derived by Spark from the given table, never stored), with one pond holding
90% of the rows.  Times the window-heavy operators with the default size
routing and with window-only routing.

Usage: python tools/stress.py [replicas=100] [sf_dir=/root/testdata/sf0.1]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from pondlake.fixtures import events_readings  # noqa: E402
from pondlake.operators import drift as D  # noqa: E402
from pondlake.operators import learn as L  # noqa: E402
from pondlake.operators import ordinal  # noqa: E402
from pondlake.operators import series as S  # noqa: E402
from pondlake.session import get_session  # noqa: E402


def main(argv):
    replicas = int(argv[1]) if len(argv) > 1 else 100
    sf_dir = argv[2] if len(argv) > 2 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 64, driver_memory="16g")
    base = events_readings(spark, sf_dir)
    big = (base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
               .select(F.when(F.col("entry_id") % 10 < 9, F.lit("hot"))
                        .otherwise(F.col("pond_id")).alias("pond_id"),
                       (F.col("created_at") + F.make_interval(days=F.col("rep") * 40)).alias("created_at"),
                       (F.col("entry_id") * replicas + F.col("rep")).alias("entry_id"), "value", "k"))
    ops = {"overview": lambda: S.overview(big, ["value", "k"], 123456),
           "trend_all": lambda: S.trend_all(big, ["value", "k"]),
           "monitor": lambda: D.monitor(big, ["value", "k"], 10000),
           "medians": lambda: L.exact_medians(big, ["value", "k"])}
    out, medians = {}, {}
    for mode, limit in (("routed", ordinal.SMALL_GROUP_ROWS), ("window_only", 10 ** 15)):
        ordinal.SMALL_GROUP_ROWS = limit
        for name, fn in ops.items():
            t0 = time.perf_counter()
            if name == "medians":
                medians[mode] = sorted(tuple(r) for r in fn().collect())
            else:
                fn().write.format("noop").mode("overwrite").save()
            out[f"{mode}.{name}"] = round(time.perf_counter() - t0, 2)
    print(json.dumps({"replicas": replicas, "sec": out,
                      "medians_equal": medians["routed"] == medians["window_only"],
                      "medians": medians["routed"]}))


if __name__ == "__main__":
    main(sys.argv)

"""Times the headline queries: one warm-up, then the median of three runs each (of one, for slow ones); prints one
JSON line, and each figure on stderr as it comes. A run that takes too long is cancelled and named under `missing`."""

from __future__ import annotations

import json
import os
import statistics
import sys
import threading
import time

from orrery.plans import registry
from orrery.session import local_session

HEADLINE = [
    "risk_wide_row", "covariance_decomposition", "technical_indicators", "donchian_breakout", "regime_onsets", "support_resistance",
    "article_dedup", "language_id", "sentiment_rollup", "event_detection", "node_similarity", "cosine_topk", "upsert_latest",
    "usage_rollup", "alert_rules", "position_accounting", "tumbling_windows", "session_windows", "as_of_join",
]


#: Seconds of one run, after which its jobs are cancelled; and of all.
LIMIT, TOTAL = 90, 1500


def timed(spark, name: str, sf: str) -> float | None:
    """Seconds of a run, None if it took more than LIMIT or failed."""
    stop = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
    stop.start()
    began = time.time()
    try:
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.time() - began
    except Exception as e:
        print(f"{name}: {type(e).__name__} after {time.time() - began:.1f} s", file=sys.stderr, flush=True)
        return None
    finally:
        stop.cancel()


def main() -> None:
    sf, start = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), time.time()
    spark = local_session("bench", memory="16g")
    took = {}
    for name in HEADLINE:
        if time.time() - start > TOTAL:
            print(f"{name}: not run, out of time", file=sys.stderr, flush=True)
            continue
        first = timed(spark, name, sf)
        runs = [] if first is None else [t for _ in range(3 if first < 15 else 1) if (t := timed(spark, name, sf)) is not None]
        if runs:
            took[name] = round(statistics.median(runs), 3)
            print(f"{name}: {took[name]} s", file=sys.stderr, flush=True)
    scale = os.path.basename(sf.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total of median query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "missing": [n for n in HEADLINE if n not in took], "sf": scale}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

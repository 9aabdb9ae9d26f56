"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores.
"""

import json
import os
import time

from netspark.plans import catalog
from netspark.plans import fixtures as fx
from netspark.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ["metric_rows", "node_l2", "node_l3", "protocol_totals", "active_keys", "flow_sessions", "flow_summary", "handshake", "tcp_close",
           "tcp_sequence_quality", "rtt_samples", "turns", "decode_l4", "dns_txn", "http_txn", "mysql_txn", "all_events"]


def timed(make) -> float:
    start = time.time()
    make().write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    spark = local_session(CPUS, "bench")
    spark.range(10).selectExpr("sum(id)").collect()
    # The shared tables are written once; every query reads them.
    seconds = {"packets_table": timed(lambda: fx.packets(spark, SF_DIR)),
               "flow_packets_table": timed(lambda: fx.flow_packets(spark, SF_DIR))}
    packets = fx.packets(spark, SF_DIR).count()
    for key in QUERIES:
        seconds[key] = timed(lambda: catalog.QUERIES[key](spark, SF_DIR))
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "packets": packets,
                      "packets_per_sec": {k: round(packets / s) for k, s in seconds.items() if s > 0}}))


if __name__ == "__main__":
    main()

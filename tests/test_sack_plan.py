"""Round trips with selective acknowledgements place the numbers once."""

import contextlib
import io

from pyspark.sql import functions as F

from helpers import packets
from netspark import schema as S
from netspark.operators import flows, tcp


def test_readers_of_segments_and_blocks_share_one_placing(spark):
    rows = [{"ts_us": 0, "tcp_flags": S.SYN, "tcp_seq": 99}, *[{"ts_us": i * 1000, "tcp_seq": 100 * i, "payload_len": 100} for i in range(1, 6)],
            {"ts_us": 9000, "up": "s", "tcp_ack": 100}]
    blocks = F.when(F.col("packet_id") == 6, F.array(F.struct(F.lit(300).cast("bigint").alias("left"), F.lit(500).cast("bigint").alias("right"))))
    line = tcp.positions(flows.packets_with_flow(packets(spark, rows)).withColumn("sacks", blocks))
    samples = tcp.rtt_samples(line)
    assert [(r.sent_us, r.rtt_us) for r in samples.filter("side = 1").orderBy("sent_us").collect()] == [(3000, 6000), (4000, 5000)]
    with contextlib.redirect_stdout(io.StringIO()) as out:
        samples.explain("simple")
    assert "tcp_ack" not in out.getvalue()

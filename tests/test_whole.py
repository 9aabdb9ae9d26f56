"""Keys of few rows are one slice and get the plain window; the results are those of slices."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import packets
from netspark import schema as S
from netspark.operators import flows, tcp
from netspark.operators.prefix import Prior, with_priors, with_steps

SEC = S.US


def text(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_whole_and_divided_keys_together(spark):
    rng = random.Random(7)
    rows = [(k, rng.randrange(200), i, rng.choice([None, 1, 2, 30]), S.WHOLE if k % 2 else 10) for i, k in enumerate(rng.choices(range(8), k=600))]
    df = spark.createDataFrame(rows, "k INT, t BIGINT, id BIGINT, v INT, slice_us BIGINT")
    kinds = ["lag", "last", "sum", "max", "min"]
    w = Window.partitionBy("k").orderBy("t", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.lag("v").over(w).alias("lag"), F.last("v", ignorenulls=True).over(before).alias("last"),
                     F.coalesce(F.sum("v").over(before), F.lit(0)).alias("sum"), F.max("v").over(before).alias("max"), F.min("v").over(before).alias("min"))
    got = with_priors(df, ["k"], ["t", "id"], F.floor(F.col("t") / 10), [Prior(k, k, F.col("v")) for k in kinds])
    assert text(got, want.columns) == text(want, want.columns)
    args = (["k"], ["t", "id"], F.floor(F.col("t") / 10), F.struct("v"), lambda a, b: a["v"] != b["v"], "run", 1, "last")
    columns = ["k", "id", "run", "last"]
    assert text(with_steps(df, *args), columns) == text(with_steps(df.drop("slice_us"), *args), columns)


def test_quiet_flows_are_whole_and_equal_sliced_ones(spark):
    rng = random.Random(8)
    rows, t = [], 1000 * SEC
    for _ in range(400):
        t += rng.choice([1000, SEC, 7 * SEC, 700 * SEC])
        up = rng.choice("cs")
        rows.append({"ts_us": t, "up": up, "src_port" if up == "c" else "dst_port": 1000 + rng.randrange(3), "tcp_flags": rng.choice([2, 16, 16, 16, 17, 18]),
                     "tcp_seq": rng.randrange(5000), "tcp_ack": rng.randrange(5000), "payload_len": rng.choice([0, 9])})
    df = packets(spark, rows)
    whole, cut = flows.packets_with_flow(df).cache(), flows.packets_with_flow(df, slice_us=5 * SEC).cache()
    assert [r[0] for r in whole.select("slice_us").distinct().collect()] == [S.WHOLE] and whole.count() == flows.with_flow_key(df).count()
    same = [c for c in whole.columns if c != "slice_us"]
    assert text(whole, same) == text(cut, same)
    for job in (lambda x: tcp.rtt_samples(tcp.positions(x)), tcp.turns, tcp.packet_gaps):
        a, b = job(whole), job(cut)
        assert text(a, b.columns) == text(b, b.columns)

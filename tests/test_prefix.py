"""Sliced scans give what a plain window gives, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import net
from netspark.operators.late import newest_time
from netspark.operators.prefix import Prior, time_slice, unwrap, with_priors, with_slice_width, with_steps


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.6 else rng.randrange(2, 30), rng.randrange(0, 500), i, rng.choice([None, 1, 2, 3, 40])) for i in range(3000)]
    return spark.createDataFrame(rows, "k INT, t BIGINT, id BIGINT, v INT").cache()


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("descending", [False, True])
def test_equals_plain_window(skewed, width, descending):
    kinds = ["lag", "last", "sum", "max", "min"]
    got = with_priors(skewed, ["k"], ["t", "id"], F.floor(F.col("t") / width), [Prior(k, k, F.col("v")) for k in kinds], descending)
    order = [F.desc(c) if descending else F.asc(c) for c in ("t", "id")]
    w = Window.partitionBy("k").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select("*", F.lag("v").over(w).alias("lag"), F.last("v", ignorenulls=True).over(before).alias("last"),
                         F.coalesce(F.sum("v").over(before), F.lit(0)).alias("sum"), F.max("v").over(before).alias("max"), F.min("v").over(before).alias("min"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_unwrap_passes_many_wraps(spark):
    true = [0]
    rng = random.Random(5)
    for _ in range(200):
        true.append(true[-1] + rng.randrange(-1000, 1 << 30))
    rows = [(1, i, (v + 4_000_000_000) % (1 << 32)) for i, v in enumerate(true)]
    df = spark.createDataFrame(rows, "k INT, t BIGINT, seq BIGINT")
    got = unwrap(df, ["k"], ["t"], F.floor(F.col("t") / 13), "seq", "pos").orderBy("t")
    assert [r.pos for r in got.collect()] == true


def test_newest_time(spark):
    df = spark.createDataFrame([(0, 10), (1, 30), (2, 20), (3, 40)], "packet_id BIGINT, ts_us BIGINT")
    got = newest_time(df).orderBy("packet_id").collect()
    assert [(r.account_us, r.late) for r in got] == [(10, False), (30, False), (30, True), (40, False)]


def test_a_burst_gets_narrow_slices(spark):
    # A busy key that idles for days around one burst, and a quiet key.
    burst = spark.range(20_000).selectExpr("1 AS k", "IF(id < 10, id * 86400000000, 900000000000 + id * 7) AS t")
    df = burst.unionByName(spark.range(50).selectExpr("2 AS k", "id * 1000000 AS t")).withColumn("ts_us", F.col("t"))
    rows = with_slice_width(df, ["k"], rows=1000)
    slices = rows.withColumn("s", time_slice(rows)).groupBy("k", "s").count()
    assert slices.agg(F.max("count")).first()[0] <= 1000
    assert slices.filter("k = 1").count() < 200 and rows.filter("k = 2").select("slice_us").distinct().first()[0] == S.SLICE_US
    assert rows.groupBy("k").agg(F.count_distinct("slice_us").alias("n")).agg(F.max("n")).first()[0] == 1


def test_steps_over_slices_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(k, t, rng.choice([1, 1, -1, None])) for k in ("a", "b", "c") for t in rng.sample(range(1000), 1 if k == "c" else 120)]
    df = spark.createDataFrame(rows, "k string, t bigint, dir int")
    out = with_steps(df, ["k"], ["t"], F.floor(F.col("t") / 50), F.struct("dir", "t"), lambda a, b: (a["dir"] != b["dir"]) | (b["t"] - a["t"] > 30),
                     "run", first=1, previous="last")
    assert out.columns == ["k", "t", "dir", "run", "last"]
    got = {(r.k, r.t): (r.run, r["last"] and r["last"].t) for r in out.collect()}
    want = {}
    for key in ("a", "b", "c"):
        run, last = 0, None
        for _, t, d in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            turned = last is not None and None not in (d, last[1]) and d != last[1]
            run += last is None or turned or t - last[0] > 30
            want[key, t] = (run, last and last[0])
            last = (t, d)
    assert got == want
    assert with_steps(df.filter("false"), ["k"], ["t"], F.lit(0), F.struct("t"), lambda a, b: b["t"] - a["t"], "n").count() == 0


def test_ends_of_a_flow_are_ordered_with_missing_numbers_first(spark):
    ends = [(1, 5, 2, 4), (2, 4, 1, 5), (3, 9, 3, 8), (3, None, 3, 8), (3, 8, 3, None), (None, 1, 0, 2), (7, 7, 7, 7)]
    df = spark.createDataFrame([(i, *e, 6) for i, e in enumerate(ends)], "i int, src_ip bigint, src_port int, dst_ip bigint, dst_port int, ip_proto int")
    df = df.withColumns({c: F.lit(None).cast("bigint") for c in ("icmp_id", "icmp_seq", "icmp_type")})
    got = {r.i: (r.ip_a, r.port_a, r.ip_b, r.port_b) for r in df.select("i", *net.flow_key_columns()).collect()}
    low = lambda e: tuple(-1 if v is None else v for v in e)
    assert got == {i: sum(sorted([e[:2], e[2:]], key=low), ()) for i, e in enumerate(ends)}

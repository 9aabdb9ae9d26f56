"""Work that must not grow with the number of groups, windows or parts beyond the rows themselves."""

import glob

import pyarrow as pa
from pyspark.sql import functions as F

from netspark.operators import tcp
from netspark.operators.prefix import grouped
from netspark.plans import fixtures as fx
from netspark.plans import queries_streaming as qs
from netspark.session import with_scheme, work_dir
from netspark.sources import captures, http_wire, sinks

SEC = 1_000_000


def plan(df) -> str:
    return df._jdf.queryExecution().toString() if hasattr(df, "_jdf") else ""


def test_groups_are_whole_and_share_batches(spark):
    """Thousands of small groups, one of many batches, one of a null key."""
    rows = spark.range(60_000).select(F.when(F.col("id") < 30_000, 7).when(F.col("id") % 5 > 0, F.col("id") % 4001 + 10).alias("k"), "id")
    got = grouped(rows, ["k"], lambda group: [(len(group), sum(i for i, in group))], [("n", pa.int64(), "BIGINT"), ("s", pa.int64(), "BIGINT")])
    want = rows.groupBy("k").agg(F.count("id").alias("n"), F.sum("id").alias("s"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_first_arrivals_make_no_call_a_bucket(spark):
    df = spark.createDataFrame([(1, 0, 5, 1, 1), (2, 3, 9, 2, 2)], "side INT, pos BIGINT, pos_end BIGINT, ts_us BIGINT, packet_id BIGINT")
    pieces = tcp.first_arrivals(df, df.select("side", F.lit(0).alias("start")), ["side"])
    assert "FlatMapGroups" not in plan(pieces) and pieces.count() == 2


def test_messages_make_no_call_a_chunk(spark):
    ask = b"GET /a HTTP/1.1\r\nHost: h\r\n\r\n"
    df = spark.createDataFrame([(f, 1, 0, 1, ask) for f in range(50)], "flow_id INT, side INT, pos BIGINT, ts_us BIGINT, payload BINARY")
    messages = http_wire.body_framing(df, ["flow_id"])
    assert "FlatMapGroups" not in plan(messages) and messages.count() == 50


def test_shared_paths_carry_their_scheme(spark):
    path = with_scheme(spark, f"{work_dir(spark)}/captures")
    assert path == f"file:{work_dir(spark)}/captures" and with_scheme(spark, "hdfs://n/x") == "hdfs://n/x"
    cluster = type("Cluster", (), {"sparkContext": type("C", (), {"master": "local-cluster[3,4,10000]"})})
    assert captures.shared(cluster, fx.fresh_path(spark, "captures"))


def test_windows_share_folders(spark, tmp_path):
    frame = lambda part: spark.createDataFrame(part, "window_us BIGINT, count BIGINT")
    rows, path = [(w * 30 * SEC, w) for w in range(240)] + [(None, 5)], str(tmp_path / "metrics")
    sinks.write_metrics(frame(rows), path)
    sinks.write_metrics(frame([(w, n + 1000) for w, n in rows if w is None or w < 45 * 60 * SEC]), path)
    got = {(r.window_us, r["count"]) for r in spark.read.parquet(path).collect()}
    assert got == {(w, n + 1000 if w is None or w < 45 * 60 * SEC else n) for w, n in rows} and spark.read.parquet(path).count() == 241
    assert len(glob.glob(f"{path}/day=*/hour=*")) == 3


def test_a_part_is_one_batch_of_many_files(spark):
    rows = spark.range(0, 400, 1, 4).select("id", (F.col("id") * SEC).alias("ts_us"))
    out, checkpoint = fx.fresh_path(spark, "out"), fx.fresh_path(spark, "cp")
    runs = qs.run_parts(spark, qs.parts_of(rows), "parts", lambda stream: stream.writeStream.format("parquet").option("path", out)
                        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    batches = [[p["numInputRows"] for p in run.recentProgress if p["numInputRows"]] for run in runs]
    assert [len(b) for b in batches] == [1, 1, 1] and sum(sum(b) for b in batches) == 400
    assert spark.read.parquet(out).select(F.input_file_name()).distinct().count() > 3


def test_a_table_is_built_once(spark, monkeypatch):
    """Counting the partitions of a plan with shuffles would run them once more."""
    def refused(rows):
        raise AssertionError("the partitions of a built table are counted")
    monkeypatch.setattr(fx, "spread", refused)
    built = fx.materialized(spark, "/nowhere", "built-once", lambda: spark.range(100).groupBy((F.col("id") % 3).alias("k")).count())
    assert built.count() == 3


def test_packets_of_a_conversation_stay_together(spark):
    found = fx.packets(spark, "/root/testdata/sf0.001").select("conv_id", F.input_file_name().alias("f"))
    assert found.select("f").distinct().count() > 1
    assert found.distinct().groupBy("conv_id").count().filter("count > 1").isEmpty()


def test_the_end_row_is_one_that_the_job_takes(spark):
    rows = spark.range(0, 100, 1, 4).select("id", (F.col("id") * SEC).alias("ts_us"))
    assert [r.id for r in qs.parts_of(rows, ends=F.col("id") == 61)[-1].collect()] == [61]

"""Streaming jobs run to the end of the given tables; they give what the batch SQL gives."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import net
from netspark.operators import flows, late
from netspark.plans import fixtures as fx
from netspark.plans import frames as fr
from netspark.plans import oracle as o
from netspark.plans.queries_bytes import TAG
from netspark.plans.queries_events import _LOOKUP, _RULES, rule_lines
from netspark.plans.queries_flows import SUMMARY
from netspark.plans.queries_nodes import _metrics_oracle
from netspark.plans.registry import ORACLES, query
from netspark.sources import captures, decode
from netspark.streaming import jobs
from netspark.streaming.keyed import COUNTERS
from netspark.streaming.output import read_output

P, SS, SESSION = o.ORACLE_PACKETS, o.SESSIONS, o.SESSION


LATE_US = 4_000_000
DAY_US = 86_400 * S.US


ALL_FILES = 1_000_000


def finish(started):
    started.awaitTermination()
    if started.exception():
        raise started.exception()
    return started


def run_parts(spark, parts: list[DataFrame], name: str, start) -> list:
    """A job run on a folder that grows by one part after the other, as a collector would fill it; the finished runs.

    Each run goes on from the checkpoint of the one before and takes the new
    part as one micro-batch.  A part is written by as many tasks as its table
    is read by, in as many files.
    """
    path, runs = fx.fresh_path(spark, f"in-{name}"), []
    for part in parts:
        part.write.mode("append").parquet(path)
        runs.append(finish(start(jobs.stream_table(spark, path, part.schema, files_per_batch=ALL_FILES))))
    return runs


def parts_of(rows: DataFrame, parts: int = 3, ends: Column | None = None) -> list[DataFrame]:
    """A table as it arrives, up to four seconds late, so parts overlap in time.

    With `ends` one more row follows, far ahead in time, so that the watermark
    passes all that came before it; that row itself is held back.  It is one
    for which `ends` holds: a row that the job leaves out moves no watermark.
    The bounds of a part's times let a reader pass over what cannot be in it.
    """
    first, last = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    width = (last - first + LATE_US) // parts + 1
    arrival = F.col("ts_us") + F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("payload", "head")]), F.lit(LATE_US))
    near = lambda i: F.col("ts_us").between(first + i * width - LATE_US, first + (i + 1) * width)
    out = [rows.filter(near(i)).filter(F.floor((arrival - first) / width) == i) for i in range(parts)]
    return out if ends is None else [*out, rows.filter(ends).limit(1).withColumn("ts_us", F.lit(last + 10**11))]


def output(spark, job, rows: DataFrame, name: str, ends: Column | None = None, **options) -> DataFrame:
    """What a job appends by the time its input has ended."""
    out, checkpoint = fx.fresh_path(spark, name), fx.fresh_path(spark, "cp")
    for started in run_parts(spark, parts_of(rows, ends=F.lit(True) if ends is None else ends), name, lambda stream: job(stream, out, checkpoint, **options)):
        if jobs.dropped_rows(started):
            raise RuntimeError("rows came behind the watermark")
    return spark.read.parquet(out)


_NODE_METRICS = _metrics_oracle(services=False)


@query("stream_node_metrics", o.with_(P, o.ENDS, o.FACTS, _NODE_METRICS, "SELECT * FROM metrics"))
def stream_node_metrics(spark, sf):
    """Periods the stream finished, and the last ones flushed at the end of the input."""
    packets, out, checkpoint = fx.packets(spark, sf), fx.fresh_path(spark, "metrics"), fx.fresh_path(spark, "cp")
    started = run_parts(spark, parts_of(packets), "packets", lambda stream: jobs.stream_node_metrics(stream, out, checkpoint))
    return read_output(spark, out).unionByName(jobs.final_flush(packets, jobs.watermark_us(started[-1])))


@query("final_flush", o.with_(P, o.ENDS, o.FACTS, _NODE_METRICS, """
SELECT metric, CAST(sum(count) AS BIGINT) AS count, count(DISTINCT window_us) AS windows FROM metrics GROUP BY metric"""))
def final_flush(spark, sf):
    """Totals over finished and flushed periods."""
    return stream_node_metrics(spark, sf).groupBy("metric").agg(F.sum("count").alias("count"), F.countDistinct("window_us").alias("windows"))


@query("stream_flows", o.with_(P, SS, SUMMARY, f"""
SELECT {o.KEY}, client_ip, client_port, server_ip, server_port, start_us, way, at_us,
  CASE way WHEN 'close' THEN client_pkts END AS client_pkts, CASE way WHEN 'close' THEN client_bytes END AS client_bytes,
  CASE way WHEN 'close' THEN server_pkts END AS server_pkts, CASE way WHEN 'close' THEN server_bytes END AS server_bytes
FROM (SELECT *, 'open' AS way, start_us AS at_us FROM summary UNION ALL SELECT *, 'close', last_us FROM summary
      UNION ALL SELECT *, 'tick', unnest(generate_series(start_us + 5000, last_us, 5000)) FROM summary)"""))
def stream_flows(spark, sf):
    """Open, tick and close records."""
    tracked = net.is_ipv4() & (F.col("frag_offset") == 0) & ~net.syn_with_data()
    rows = output(spark, jobs.stream_flows, fx.packets(spark, sf), "flows", ends=tracked, cycle_us=5000)
    closing = F.col("way") == "close"
    return rows.select(*S.FLOW_KEY, "client_ip", "client_port", "server_ip", "server_port", "start_us", "way", "at_us",
                       *[F.when(closing, F.col(c)).alias(c) for c in COUNTERS])


_DNS = ["flow_id", "dns_id", "client_ip", "server_ip", "qname", "qtype", "opcode", "rcode", "req_us", "rsp_us", "req_pkts", "rsp_pkts", "wait_ms", "req_timeout"]


@query("stream_dns", f"SELECT {', '.join(_DNS)} FROM ({ORACLES['dns_txn']})")
def stream_dns(spark, sf):
    """The stream's transactions; the SQL is that of the batch."""
    return output(spark, jobs.stream_dns, fx.dns_msgs(spark, sf), "dns").select(
        *_DNS[:6], *[F.col(c).cast("int").alias(c) for c in _DNS[6:8]], *_DNS[8:])


@query("stream_dns_joined", f"SELECT {', '.join(_DNS)} FROM ({ORACLES['dns_txn']})")
def stream_dns_joined(spark, sf):
    """The same transactions from an outer interval join."""
    return output(spark, jobs.stream_dns_joined, fx.dns_msgs(spark, sf), "dns-joined").select(*_DNS)


@query("stream_late_packets", f"SELECT * FROM ({ORACLES['late_packets']})")
def stream_late_packets(spark, sf):
    """Packets in files of rising ids; the SQL is that of the batch."""
    packets, out, marks, checkpoint = fx.packets(spark, sf), *(fx.fresh_path(spark, n) for n in ("late", "marks", "cp"))
    last = packets.agg(F.max("packet_id")).first()[0]
    parts = [packets.filter(F.floor(F.col("packet_id") * 3 / (last + 1)) == i) for i in range(3)]
    counts = {}
    run_parts(spark, parts, "late", lambda rows: jobs.stream_late(rows, out, marks, checkpoint, told=lambda n, metric: counts.__setitem__(n, metric["late"])))
    found = spark.read.parquet(out)
    if found.filter("late = true").count() != sum(counts.values()):
        raise RuntimeError("the late packets are not as many as were observed")
    return found.select("packet_id", "ts_us", "account_us", F.col("late").cast("boolean").alias("late"))


@query("stream_http_mysql", o.with_(o.ORACLE_HTTP, o.ORACLE_MYSQL, f"""
SELECT 'http' AS app, flow_id, turn_no, 'open' AS way, ts_us AS at_us, CAST(NULL AS BIGINT) AS rsp_count, CAST(NULL AS BIGINT) AS rsp_bytes FROM h WHERE kind = 'req'
UNION ALL SELECT 'http', flow_id, turn_no, 'close', p.ts_us, NULL, NULL FROM (SELECT * FROM h WHERE kind = 'req') q JOIN (SELECT * FROM h WHERE kind = 'rsp') p USING (flow_id, turn_no)
UNION ALL SELECT 'mysql', flow_id, command_no, 'open', min(ts_us) FILTER (WHERE is_command = 1), NULL, NULL FROM m GROUP BY flow_id, command_no
UNION ALL SELECT 'mysql', flow_id, command_no, 'close', max(ts_us) FILTER (WHERE is_command = 0), {o.count_if('is_command = 0')}, {o.sum_if('bytes', 'is_command = 0')}
  FROM m GROUP BY flow_id, command_no HAVING count(*) FILTER (WHERE is_command = 0) > 0
""".replace("FROM h ", "FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, kind ORDER BY ts_us, n) AS turn_no FROM http_msgs) ").replace(
    "FROM m ", "FROM (SELECT * FROM (SELECT *, CAST(sum(is_command) OVER (PARTITION BY flow_id ORDER BY ts_us, is_command DESC, bytes ROWS UNBOUNDED PRECEDING) AS BIGINT) AS command_no FROM mysql_msgs) WHERE command_no > 0) ")))
def stream_http_mysql(spark, sf):
    """Open and close events of HTTP transactions and MySQL commands."""
    none = F.lit(None).cast("bigint")
    # The fixtures begin at the epoch, where no watermark lies behind a row; the streams run a day later.
    http = fx.http_msgs(spark, sf).select("flow_id", "kind", (F.col("ts_us") + DAY_US).alias("ts_us"), "n")
    events = output(spark, jobs.stream_transactions, http, "http").select(
        F.lit("http").alias("app"), "flow_id", "turn_no", "way", (F.col("at_us") - DAY_US).alias("at_us"), none.alias("rsp_count"), none.alias("rsp_bytes"))
    mysql = fx.mysql_msgs(spark, sf).withColumn("ts_us", F.col("ts_us") + DAY_US)
    commands = jobs.mysql_updates(output(spark, jobs.stream_mysql, mysql, "mysql")).withColumns({c: F.col(c) - DAY_US for c in ("open_us", "rsp_us")})
    commands = commands.withColumn("app", F.lit("mysql")).withColumnRenamed("command_no", "turn_no")
    opened = commands.select("app", "flow_id", "turn_no", F.lit("open").alias("way"), F.col("open_us").alias("at_us"), none.alias("rsp_count"), none.alias("rsp_bytes"))
    closed = commands.filter("rsp_count > 0").select("app", "flow_id", "turn_no", F.lit("close").alias("way"), F.col("rsp_us").alias("at_us"), "rsp_count", "rsp_bytes")
    return events.unionByName(opened).unionByName(closed)


@query("reload_rules", o.with_(P, SS, SUMMARY, _RULES, f"""
SELECT {SESSION}, coalesce({_LOOKUP('s.client_ip', 's.client_port')}, {_LOOKUP('0', 's.client_port')},
  {_LOOKUP('s.server_ip', 's.server_port')}, {_LOOKUP('0', 's.server_port')}) AS rule_name FROM summary s"""))
def reload_rules(spark, sf):
    """Flows tagged by a stream that reads the rule file in every micro-batch."""
    out = fx.fresh_path(spark, "tags")
    summary = flows.flow_summary(fx.flow_packets(spark, sf)).withColumn("ts_us", F.col("start_us"))
    rules, checkpoint = rule_lines(spark, sf), fx.fresh_path(spark, "cp")
    run_parts(spark, parts_of(summary), "flows", lambda stream: jobs.stream_app_tags(stream, rules, out, checkpoint))
    return read_output(spark, out).select(*S.SESSION, "rule_name")


@query("stream_captures", o.with_(P, f"""
SELECT ts_us, CAST(wire_len + {TAG} AS INTEGER) AS wire_len, src_ip, dst_ip, src_port, dst_port, tcp_seq, TRUE AS unique_id, TRUE AS in_order FROM packets"""))
def stream_captures(spark, sf):
    """Capture files picked up by a stream, decoded and written as packets; ids are unique and follow each file's time."""
    path, out = fx.fresh_path(spark, "captures"), fx.fresh_path(spark, "packets")
    fr.write_capture_files(fr.frames(spark, sf), path, files=6)
    frames = captures.number_packets(captures.stream_capture_files(spark, path, fx.fresh_path(spark, "numbers") + "/last.json"))
    finish(decode.decode(frames.drop("cap_len")).drop("frame").writeStream.format("parquet").option("path", out)
           .option("checkpointLocation", fx.fresh_path(spark, "cp")).trigger(availableNow=True).start())
    rows = spark.read.parquet(out)
    ids = rows.groupBy(F.col("packet_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(ids, F.col("packet_id") == F.col("_id")).withColumn("file_no", F.shiftright("packet_id", 40))
    rows = late.newest_time(rows.withColumn("place", F.col("packet_id").bitwiseAND(F.lit((1 << 40) - 1))), "place", ["file_no"])
    return rows.select("ts_us", "wire_len", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_seq", (F.col("_n") == 1).alias("unique_id"), (~F.col("late")).alias("in_order"))

"""Streaming jobs.  Each ends in the same rows as the batch function on the same input."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from netspark import schema as S
from netspark.functions import net
from netspark.operators import flows, late, metrics, nodes, transactions as tx
from netspark.operators.sessions import Timeouts
from netspark.session import settings
from netspark.sources import rules
from netspark.streaming import keyed
from netspark.streaming.output import write_batch

DELAY = "10 seconds"


def stream_table(spark: SparkSession, path: str, schema: T.StructType, delay: str = DELAY, files_per_batch: int = 1000) -> DataFrame:
    """A folder of parquet files as a stream with event time `ts`."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", net.as_timestamp()).withWatermark("ts", delay)


def run(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], trigger: dict | None = None) -> StreamingQuery:
    """Start a query that hands every micro-batch to `each`."""
    return (rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def watermark_us(query: StreamingQuery) -> int | None:
    """Event-time watermark a finished query reached."""
    from datetime import datetime
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p.get("eventTime", {})]
    if not marks:
        return None
    latest = max(datetime.fromisoformat(m.replace("Z", "+00:00")) for m in marks)
    return int(latest.timestamp() * S.US)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that Spark's own state operators left out because they came behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


# ---- node metrics: windowed aggregation, one append per finished period ----

#: State lies in files on the executors, under one bound of memory for all partitions of an executor: each open partition
#: keeps a cache of its own otherwise.  The number of rows is not kept, which costs a look-up per write.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
         "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def stream_sums(packets: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    """`metrics.node_sums` as a stream: partial sums per task, then one row of state per period and node.

    A node's packets are of several classes, so facts told by class would be
    some times as many rows of state.
    """
    ip = net.is_ipv4()
    whole = ip & (F.col("frag_offset") == 0)
    amounts = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(n) for c, n in (("wire_len", "bytes"), ("l3_len", "l3_bytes"), ("l4_len", "l4_bytes"))]
    rows = nodes.both_ends(packets, seconds).select(
        F.window("ts", f"{seconds} seconds").alias("period"), "mac", F.when(whole, F.col("vlan_id")).alias("vlan_id"),
        F.when(whole, F.col("ip")).alias("ip"), "dir", net.l2_type().alias("l2_type"),
        F.when(net.mac_class("mac") == "ucast", net.mac_class("peer_mac")).alias("cast_class"),
        net.size_bucket().alias("size_rank"), F.when(whole, net.l3_type()).alias("l3_type"), F.lit(1).cast("bigint").alias("packets"), *amounts)
    sums = rows.groupBy("period", "mac", "vlan_id", "ip").agg(*metrics.node_sums())
    return sums.withColumn("window_us", F.unix_micros("period.start")).drop("period")


def stream_node_metrics(packets: DataFrame, out: str, checkpoint: str, seconds: int = S.PERIOD_S, trigger: dict | None = None) -> StreamingQuery:
    """Metric rows of each period once the watermark has passed its end.

    All nodes of a period leave the state in the same batch, so the metric
    rows are made from the batch alone.
    """
    def each(sums: DataFrame, batch_id: int) -> None:
        sums = sums.persist()
        write_batch(metrics.metrics_of_sums(sums), out, batch_id)
        sums.unpersist()

    with settings(packets.sparkSession, STATE):
        return run(stream_sums(packets, seconds), checkpoint, each, trigger)


def final_flush(packets: DataFrame, reached_us: int, seconds: int = S.PERIOD_S) -> DataFrame:
    """Metric rows of the periods still open at the end of the input."""
    open_ = net.window_us(seconds) + seconds * S.US > reached_us
    return metrics.node_metrics(nodes.node_facts(packets.filter(open_), seconds))


# ---- flows ----

def stream_flows(packets: DataFrame, out: str, checkpoint: str, cycle_us: int = S.TICK_S * S.US, timeouts: Timeouts = Timeouts(),
                 trigger: dict | None = None) -> StreamingQuery:
    """Open, tick and close records of flows, from keyed state with a timer per session.

    Packets are taken in the order of their times, up to the watermark's delay
    late ones included.  A flow is the unit of state, so one flow's packets of
    a micro-batch go to one task.
    """
    src, _ = net.flow_ends()
    kind = (F.when(F.col("ip_proto") != S.PROTO_TCP, keyed.PLAIN).when(net.pure_syn(), keyed.SYN).when(net.has_flag(S.SYN), keyed.ANSWER)
            .when(net.has_flag(S.FIN | S.RST), keyed.END).otherwise(keyed.PLAIN))
    rows = flows.with_flow_key(packets).withColumns({
        "kind": kind, "seq": F.coalesce("tcp_seq", F.lit(0)), "ack": F.coalesce("tcp_ack", F.lit(0)),
        "up": (src == F.struct(F.col("ip_a").alias("ip"), F.col("port_a").alias("port"))).cast("int")})
    rows = rows.select(*keyed.columns(keyed.FLOW_KEYS), *keyed.columns(keyed.Flows.held), "ts")
    return keyed.append(keyed.records(rows, S.FLOW_KEY, keyed.Flows(timeouts, cycle_us)), out, checkpoint, trigger)


# ---- DNS ----

def stream_dns(messages: DataFrame, out: str, checkpoint: str, open_s: int = S.DNS_OPEN_S, trigger: dict | None = None) -> StreamingQuery:
    """Rows of `transactions.dns_txn`, without their numbers, as soon as a transaction is answered or its time is over."""
    rows = messages.select("flow_id", "dns_id", *keyed.columns(keyed.Dns.held), "ts")
    return keyed.append(tx.dns_told(keyed.records(rows, ["flow_id", "dns_id"], keyed.Dns(open_s))), out, checkpoint, trigger)


def stream_dns_joined(messages: DataFrame, out: str, checkpoint: str, open_s: int = S.DNS_OPEN_S, trigger: dict | None = None) -> StreamingQuery:
    """Queries with their answers by an outer interval join of the stream with itself.

    Both sides have the stream's watermark, so Spark drops a query from the
    state once no answer can come any more and tells it unanswered then.  A
    query that is repeated within the watermark's delay counts once; an answer
    without a query is left out.  `stream_dns` tells those, too.
    """
    query, answer = F.col("qr") == 0, F.col("qr") == 1
    ids = ["flow_id", "dns_id"]
    told = ["client_ip", "server_ip", "opcode", "qname", "qtype"]
    asked = messages.filter(query).dropDuplicatesWithinWatermark(ids).select(
        *ids, *told, F.col("ts_us").alias("req_us"), F.col("bytes").alias("req_bytes"), F.col("ts").alias("req_ts"))
    given = messages.filter(answer).select(*[F.col(c).alias(f"_{c}") for c in ids], "rcode", F.col("ts_us").alias("rsp_us"), F.col("bytes").alias("rsp_bytes"), F.col("ts").alias("rsp_ts"))
    near = F.col("rsp_ts").between(F.col("req_ts"), F.col("req_ts") + F.expr(f"INTERVAL {open_s} SECONDS"))
    pairs = asked.join(given, (F.col("flow_id") == F.col("_flow_id")) & (F.col("dns_id") == F.col("_dns_id")) & near, "left_outer")
    rows = pairs.select(*ids, *told, "rcode", "req_us", "rsp_us", F.lit(1).cast("bigint").alias("req_pkts"), "req_bytes",
                        F.col("rsp_us").isNotNull().cast("bigint").alias("rsp_pkts"), F.coalesce("rsp_bytes", F.lit(0)).alias("rsp_bytes"))
    return keyed.append(tx.dns_told(rows), out, checkpoint, trigger)


# ---- HTTP and MySQL ----

def stream_transactions(messages: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Open (request) and close (response) events of FIFO-matched transactions."""
    rows = messages.select("flow_id", *keyed.columns(keyed.Turns.held), "ts")
    return keyed.append(keyed.records(rows, ["flow_id"], keyed.Turns(S.TCP_ACTIVE_S)), out, checkpoint, trigger)


def stream_mysql(messages: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Open event of each command and updates of its responses, which belong to the last command before them."""
    rows = messages.withColumn("late", 1 - F.col("is_command"))
    rows = rows.select("flow_id", *keyed.columns(keyed.Commands.held), "ts")
    return keyed.append(keyed.records(rows, ["flow_id"], keyed.Commands(S.TCP_ACTIVE_S)), out, checkpoint, trigger)


def mysql_updates(updates: DataFrame) -> DataFrame:
    """Commands with all their updates summed."""
    return updates.groupBy("flow_id", "command_no").agg(
        F.min("open_us").alias("open_us"), F.max("rsp_us").alias("rsp_us"), F.sum("rsp_count").alias("rsp_count"), F.sum("rsp_bytes").alias("rsp_bytes"))


# ---- late packets ----

def stream_late(packets: DataFrame, out: str, marks: str, checkpoint: str, trigger: dict | None = None,
                told: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Rows of `late.newest_time` as packets arrive; those behind the newest time stand in a partition of their own, `late=true`.

    Packets of a batch come in the order of their ids.  The newest time goes
    from batch to batch as one row under `marks`.  How many packets were late
    is observed while a batch is written and handed to `told`.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{marks}/batch={batch_id - 1}").first()["newest"] if batch_id else None
        rows = late.newest_time(batch.drop("ts"))
        behind = F.coalesce(F.lit(before) > F.col("ts_us"), F.lit(False))
        rows = rows.withColumns({"account_us": F.greatest("account_us", F.lit(before).cast("bigint")), "late": F.col("late") | behind})
        seen = Observation(f"late-{batch_id}")
        rows = rows.observe(seen, nodes.count().alias("packets"), nodes.total_if(F.col("late")).alias("late"), F.max("ts_us").alias("newest"))
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{out}/batch={batch_id}")
        metric = seen.get
        newest = max((t for t in (before, metric["newest"]) if t is not None), default=None)
        write_batch(spark.createDataFrame([(newest,)], "newest bigint"), marks, batch_id)
        if told:
            told(batch_id, metric)

    return run(packets, checkpoint, each, trigger)


# ---- rules ----

def stream_app_tags(flow_rows: DataFrame, rule_path: str, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Tag flows with the rules as they are when the micro-batch runs: the file is read again each time."""
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(rules.app_tags(batch, rules.load_rules(batch.sparkSession, rule_path)), out, batch_id)

    return run(flow_rows, checkpoint, each, trigger)

"""Application transactions: match requests with responses and sum them per node.

Message tables have one row per message.  DNS: flow_id, dns_id, qr, ts_us,
client_ip, server_ip, opcode, rcode, qname, qtype, answer_count, bytes.  HTTP:
flow_id, n, kind (req/rsp), ts_us, head, body_len.  MySQL: flow_id, ts_us,
is_command, command, bytes and optionally part (set/col/row).  Very busy flows
get narrow slices here, unless the caller has given `slice_us`.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import names, net
from netspark.operators.nodes import NODE, both_ends, count, total, total_if
from netspark.operators.prefix import Prior, sliced, time_slice, with_priors, with_steps


# ---- ICMP ----

def icmp_echo(flow_packets: DataFrame) -> DataFrame:
    """Echo request and reply of one (addresses, id, sequence), as long as they follow within the ICMP timeout."""
    request, reply = F.col("icmp_type") == 8, F.col("icmp_type") == 0
    end = lambda a, b: F.max(F.when(request, F.col(a)).otherwise(F.col(b)))
    return (flow_packets.filter((F.col("ip_proto") == S.PROTO_ICMP) & (request | reply)).groupBy(*S.SESSION)
            .agg(end("src_ip", "dst_ip").alias("client_ip"), end("dst_ip", "src_ip").alias("server_ip"),
                 F.max("icmp_id").alias("icmp_id"), F.max("icmp_seq").alias("icmp_seq"),
                 F.max(F.when(request, F.col("ts_us"))).alias("req_us"), F.max(F.when(reply, F.col("ts_us"))).alias("rsp_us"),
                 total_if(request, "l4_len").alias("out_bytes"), total_if(reply, "l4_len").alias("in_bytes"))
            .withColumn("rtt_us", F.col("rsp_us") - F.col("req_us")))


# ---- DNS ----

def dns_numbered(messages: DataFrame, open_s: int = S.DNS_OPEN_S) -> DataFrame:
    """Messages with txn_no, the number of their transaction among those of (flow, id)."""
    keys, order = ["flow_id", "dns_id"], ["ts_us", "qr"]
    messages = sliced(messages, keys)
    begins = lambda before, here: (before["qr"] == 1) | (here["ts_us"] - before["ts_us"] > open_s * S.US)
    return with_steps(messages, keys, order, time_slice(messages), F.struct("qr", "ts_us"), begins, "txn_no", first=1)


def dns_txn(messages: DataFrame, open_s: int = S.DNS_OPEN_S) -> DataFrame:
    """One row per query and its response.

    Messages of one (flow, id) are cut into transactions after a response and
    after a silence longer than the query timeout; a repeated query stays in
    its transaction.  A response on its own has no request time.
    """
    return dns_rows(dns_numbered(messages, open_s))


def dns_rows(numbered_messages: DataFrame, extra: list[Column] = ()) -> DataFrame:
    """One row per transaction, with the `extra` aggregates of its messages."""
    query, answer = F.col("qr") == 0, F.col("qr") == 1
    return (numbered_messages.groupBy("flow_id", "dns_id", "txn_no")
            .agg(F.max("client_ip").alias("client_ip"), F.max("server_ip").alias("server_ip"),
                 F.max("qname").alias("qname"), F.max("qtype").alias("qtype"), F.max("opcode").alias("opcode"),
                 F.max(F.when(answer, F.col("rcode"))).alias("rcode"),
                 F.max(F.when(query, F.col("ts_us"))).alias("req_us"), F.max(F.when(answer, F.col("ts_us"))).alias("rsp_us"),
                 total_if(query).alias("req_pkts"), total_if(query, "bytes").alias("req_bytes"),
                 total_if(answer).alias("rsp_pkts"), total_if(answer, "bytes").alias("rsp_bytes"), *extra).transform(dns_told))


def dns_told(rows: DataFrame) -> DataFrame:
    """What follows from a transaction's times and code."""
    return (rows.withColumns({"wait_ms": net.to_ms(F.col("rsp_us") - F.col("req_us")), "req_timeout": F.col("rsp_us").isNull(),
                          "error": F.when(F.col("rcode").isNotNull(), names.name_of("rcode", names.DNS_RCODE, "Unknown"))}))


def dns_unanswered(transactions: DataFrame) -> DataFrame:
    return transactions.filter(F.col("rsp_us").isNull()).select(
        "flow_id", "dns_id", "client_ip", "server_ip", "qname", "req_us")


def dns_answers(messages: DataFrame) -> DataFrame:
    """One row per answer; a message without answers keeps one row."""
    return (messages.withColumn("_a", F.explode_outer("answers"))
            .select("flow_id", "dns_id", "ts_us", F.col("_a.name").alias("name"), F.col("_a.type").alias("type"),
                    F.col("_a.data").alias("data"), F.col("_a.ttl").alias("ttl")))


def node_dns(messages: DataFrame, transactions: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    """Per period, node and direction: traffic, code counts, durations, errors and timeouts.

    `messages` needs src/dst mac and ip and vlan_id besides the DNS columns.
    Durations and timeouts belong to the client's sent side and the server's
    received side of the period of the query.
    """
    query, answer = F.col("qr") == 0, F.col("qr") == 1
    sums = {"req_pkts": total_if(query), "req_bytes": total_if(query, "bytes"),
            "rsp_pkts": total_if(answer), "rsp_bytes": total_if(answer, "bytes"),
            **{f"req_opcode_{i}": total_if(query & (F.col("opcode") == i)) for i in range(3)},
            **{f"rsp_rcode_{i}": total_if(answer & (F.col("rcode") == i)) for i in range(6)},
            "rsp_errors": total_if(answer & F.col("rcode").between(1, 5))}
    traffic = both_ends(messages, seconds).select(*NODE, "dir", "qr", "opcode", "rcode", "bytes")
    asked = transactions.filter(F.col("req_us").isNotNull()).select(
        F.col("req_us").alias("ts_us"), (F.col("rsp_us") - F.col("req_us")).alias("took"), "req_timeout",
        "src_mac", "dst_mac", "vlan_id", F.col("client_ip").alias("src_ip"), F.col("server_ip").alias("dst_ip"))
    durations = both_ends(asked, seconds).select(*NODE, "dir", "took", "req_timeout")
    # Messages and durations meet in one sum; the columns of the other kind are null.
    return (traffic.unionByName(durations, allowMissingColumns=True).groupBy(*NODE, "dir")
            .agg(*[v.alias(k) for k, v in sums.items()], F.count("took").alias("rtt_count"), total("took").alias("rtt_sum"),
                 total_if(F.col("req_timeout")).alias("timeouts"), F.min("took").alias("rtt_min"), F.max("took").alias("rtt_max")))


# ---- HTTP ----

def _head(pattern: str) -> Column:
    found = F.regexp_extract("head", pattern, 1)
    return F.when(found != "", found)


def _field(name: str) -> Column:
    return F.trim(_head(rf"(?im)^{name}:[ \t]*([^\r\n]*)"))


# Patterns of the start lines.
REQUEST_LINE = r"^(" + "|".join(names.HTTP_METHODS) + r") +([^\r\n]*?) *HTTP/1\.[0-9]"
STATUS_LINE = r"^HTTP/1\.[0-9] +([0-9]+)"


def http_messages(messages: DataFrame) -> DataFrame:
    """Fields of start lines and headers.  Header names match in any case."""
    request = F.col("kind") == "req"
    length = _field("Content-Length").cast("bigint")
    url = F.regexp_extract("head", REQUEST_LINE, 2)
    coding = F.lower(_field("Content-Encoding"))
    return messages.select(
        "flow_id", "n", "kind", "ts_us", "body_len",
        F.when(request, _head(REQUEST_LINE)).alias("method"),
        F.when(request & (url != ""), url).alias("url"),
        _head(r"(?m)HTTP/1\.([0-9])[ \t]*(?:\r|\n|[0-9 ])").cast("int").alias("version"),
        F.when(~request, _head(STATUS_LINE)).cast("int").alias("status"),
        F.when(request, _field("Host")).alias("host"), F.when(request, _field("Referer")).alias("referer"),
        F.when(request, _field("User-Agent")).alias("user_agent"),
        F.when(request, _field("X-Online-Host")).alias("online_host"),
        _field("Content-Type").alias("content_type"), length.alias("content_length"),
        F.coalesce(F.lower(_field("Transfer-Encoding")).startswith("chunked"), F.lit(False)).alias("chunked"),
        F.coalesce(coding.startswith("gzip") | coding.startswith("deflate"), F.lit(False)).alias("compressed"))


def numbered(messages: DataFrame) -> DataFrame:
    """Number requests and responses of each flow in order (`turn_no` from 1)."""
    rows = sliced(messages, ["flow_id"])
    rows = with_priors(rows, ["flow_id", "kind"], ["ts_us", "n"], time_slice(rows), [Prior("_before", "sum", F.lit(1))])
    return rows.withColumn("turn_no", F.col("_before") + 1).select(*messages.columns, "turn_no")


def http_txn(parsed: DataFrame) -> DataFrame:
    """The n-th response of a connection belongs to its n-th request."""
    request = F.col("kind") == "req"
    pick = lambda side, c: F.max(F.when(side, F.col(c)))
    return (numbered(parsed).groupBy("flow_id", "turn_no")
            .agg(*[pick(request, c).alias(c) for c in ("method", "url", "host", "user_agent", "referer")],
                 pick(request, "content_type").alias("req_content_type"), pick(~request, "content_type").alias("content_type"),
                 pick(~request, "status").alias("status"), pick(~request, "chunked").alias("chunked"),
                 pick(~request, "compressed").alias("compressed"),
                 pick(request, "ts_us").alias("req_us"), pick(~request, "ts_us").alias("rsp_us"),
                 pick(request, "body_len").alias("req_bytes"), pick(~request, "body_len").alias("rsp_bytes"))
            .filter(F.col("req_us").isNotNull()))


def pipelined_requests(messages: DataFrame) -> DataFrame:
    """Requests with a flag: was another request of the flow still unanswered?"""
    change = F.when(F.col("kind") == "req", 1).otherwise(-1)
    messages = sliced(messages, ["flow_id"])
    rows = with_priors(messages, ["flow_id"], ["ts_us", "kind", "n"], time_slice(messages), [Prior("pending", "sum", change)])
    return (rows.filter(F.col("kind") == "req")
            .select("flow_id", "n", "ts_us", (F.col("pending") > 0).alias("pipelined")))


def http_times(segments: DataFrame) -> DataFrame:
    """Per transaction: request, response and wait time in ms from its segments' times."""
    request = F.col("kind") == "req"
    at = lambda f, side: f(F.when(side, F.col("ts_us")))
    return (segments.groupBy("flow_id", "turn_no")
            .agg((at(F.max, request) - at(F.min, request)).alias("_q"), (at(F.max, ~request) - at(F.min, ~request)).alias("_p"),
                 (at(F.min, ~request) - at(F.max, request)).alias("_w"),
                 total_if(request).alias("req_pkts"), total_if(~request).alias("rsp_pkts"))
            .select("flow_id", "turn_no", net.to_ms("_q").alias("req_ms"), net.to_ms("_p").alias("rsp_ms"),
                    net.to_ms("_w").alias("wait_ms"), "req_pkts", "rsp_pkts"))


def node_http(messages: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    """Per period, node and direction: requests, responses, traffic, errors and mean RTT."""
    request = F.col("kind") == "req"
    return (both_ends(messages, seconds).groupBy(*NODE, "dir")
            .agg(total_if(request).alias("requests"), total_if(~request).alias("responses"), total("pkts").alias("pkts"),
                 total("bytes").alias("bytes"), total("l2_bytes").alias("l2_bytes"),
                 total_if(request & F.col("method").isNotNull()).alias("methods"),
                 total_if(~request & (F.col("status") >= 400)).alias("errors"),
                 total("rtt_sum").alias("rtt_sum"), total("rtt_count").alias("rtt_count"))
            .withColumn("rtt_mean", net.safe_mean("rtt_sum", "rtt_count")))


def http_method_counts(parsed: DataFrame) -> DataFrame:
    """Requests by method and responses by status class."""
    label = F.when(F.col("kind") == "req", F.col("method")).otherwise(
        F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")))
    return parsed.groupBy("kind", label.alias("label")).agg(count().alias("n"))


# ---- MySQL ----

def mysql_txn(messages: DataFrame) -> DataFrame:
    """Responses belong to the last command before them."""
    if "part" not in messages.columns:
        messages = messages.withColumn("part", F.lit(None).cast("string"))
    command = F.col("is_command") == 1
    messages = sliced(messages, ["flow_id"])
    rows = messages.withColumn("_late", 1 - F.col("is_command"))
    rows = with_priors(rows, ["flow_id"], ["ts_us", "_late", "bytes"], time_slice(messages),
                       [Prior("_before", "sum", F.col("is_command"))])
    ends = lambda side, name: [F.min(F.when(side, F.col("ts_us"))).alias(f"{name}_first_us"),
                               F.max(F.when(side, F.col("ts_us"))).alias(f"{name}_last_us"),
                               total_if(side).alias(f"{name}_count"), total_if(side, "bytes").alias(f"{name}_bytes")]
    return (rows.withColumn("command_no", F.col("_before") + F.col("is_command")).filter(F.col("command_no") > 0)
            .groupBy("flow_id", "command_no")
            .agg(F.max(F.when(command, F.col("command"))).alias("command"), *ends(command, "req"), *ends(~command, "rsp"),
                 *[total_if(F.col("part") == p).alias(n) for p, n in (("row", "rows"), ("col", "cols"), ("set", "sets"))]))


def node_mysql(messages: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    """Per period, node and direction: traffic, commands, blocks and mean RTT."""
    return (both_ends(messages, seconds).groupBy(*NODE, "dir")
            .agg(count().alias("pkts"), total("bytes").alias("bytes"), total("l2_bytes").alias("l2_bytes"),
                 total("is_command").alias("commands"), total_if(F.col("is_command") == 0).alias("blocks"),
                 total("rtt_sum").alias("rtt_sum"), total("rtt_count").alias("rtt_count"))
            .withColumn("rtt_mean", net.safe_mean("rtt_sum", "rtt_count")))

"""Rule table: tags for flows by protocol, address and port."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.operators.prefix import bounded
from netspark.session import cut

# Layout of the rule file and protocol names.
FIELDS = ("proto STRING, ip STRING, port INT, flag INT, application INT, major INT, minor INT, attribute INT, name STRING")
VALUES = ["flag", "application", "major", "minor", "attribute"]
PROTO_NUMBER = {"icmp": S.PROTO_ICMP, "tcp": S.PROTO_TCP, "udp": S.PROTO_UDP, "sctp": S.PROTO_SCTP}


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a tab-separated file.  Empty fields are 0; rules without a key or a value are left out.

    The last line of a key wins, over files in the order of their names.
    """
    lines = spark.read.csv(path, sep="\t", comment="#", schema=FIELDS, mode="PERMISSIVE")
    part = lambda i: F.coalesce(F.get(F.split("ip", r"\."), F.lit(i)).cast("bigint"), F.lit(0))
    ip = F.shiftleft(part(0), 24) + F.shiftleft(part(1), 16) + F.shiftleft(part(2), 8) + part(3)
    proto = F.lower(F.trim("proto"))
    number = F.coalesce(*[F.when(proto == n, code) for n, code in PROTO_NUMBER.items()], proto.cast("int"), F.lit(0))
    zero = F.lit(0)
    rows = lines.select(number.alias("proto"), ip.alias("ip"), F.coalesce("port", zero).alias("port"),
                        *[F.coalesce(v, zero).alias(v) for v in VALUES], "name", F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("line"))
    used = ((F.col("proto") != 0) | (F.col("ip") != 0) | (F.col("port") != 0)) & F.greatest(*VALUES).__gt__(0)
    last = F.max(F.struct("line", *VALUES, "name")).alias("r")
    return rows.filter(used).groupBy("proto", "ip", "port").agg(last).select("proto", "ip", "port", *[f"r.{v}" for v in VALUES], "r.name")


def app_tags(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """Flows with the first matching rule: exact source, source port, exact destination, destination port.

    A rule for address 0 matches every address.  The rules are read and summed
    once for the four lookups.
    """
    rules = bounded(cut(rules.select("proto", "ip", "port", F.struct(*VALUES, "name").alias("tag"))))
    out = flows
    steps = [("client_ip", "client_port"), (None, "client_port"), ("server_ip", "server_port"), (None, "server_port")]
    for i, (ip, port) in enumerate(steps):
        step = rules.select(F.col("proto").alias("_p"), F.col("ip").alias("_i"), F.col("port").alias("_o"), F.col("tag").alias(f"_t{i}"))
        address = F.col(ip) if ip else F.lit(0).cast("bigint")
        cond = (F.col("ip_proto") == F.col("_p")) & (address == F.col("_i")) & (F.col(port) == F.col("_o"))
        out = out.join(step, cond, "left").drop("_p", "_i", "_o")
    hits = [f"_t{i}" for i in range(len(steps))]
    return out.withColumn("_tag", F.coalesce(*hits)).select(
        *flows.columns, *[F.col(f"_tag.{v}").alias(v) for v in VALUES], F.col("_tag.name").alias("rule_name"))

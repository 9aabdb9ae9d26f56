"""Display names of protocol codes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of protocol codes.
IP_PROTO = {1: "icmp", 6: "tcp", 17: "udp", 132: "sctp"}
ETHER_TYPE = {0x0806: "arp", 0x0800: "ipv4", 0x8100: "vlan"}
DNS_TYPE = {1: "Address", 2: "Name Server", 3: "Mail Destination", 4: "Mail Forwarder", 5: "Canonical Name",
            6: "Start of Zone", 7: "Mail Box", 8: "Mail Group", 9: "Mail Rename", 10: "Null",
            11: "Well Known Service", 12: "Domain Name Pointer", 13: "Host Information",
            14: "Mail Information", 15: "Mail Exchange", 16: "Text"}
DNS_QTYPE = {252: "AXFR", 253: "Mail Box", 254: "Mail Agent", 255: "Any"}
DNS_CLASS = {1: "Internet", 2: "CSNET", 3: "CHAOS", 4: "Hesiod"}
DNS_OPCODE = {0: "Query", 1: "I Query", 2: "Status"}
DNS_RCODE = {0: "Okay", 1: "Format", 2: "Server", 3: "Name", 4: "Implemented", 5: "Refured"}
HTTP_METHODS = ["GET", "POST", "PUT", "SEARCH", "CONNECT", "HEAD"]
ERROR_CAUSE = ["session", "syn", "ack", "req", "res"]
CREATE_CAUSE = ["normal", "abort", "failure"]
CLOSE_CAUSE = ["normal", "timeout", "reset", "abort", "broken"]
EVENT_CODE = {"flow_tick": 0, "tcp_open": 101, "tcp_close": 102, "udp_open": 201, "udp_close": 202,
              "http_request": 301, "http_response": 302, "dns": 401, "mysql": 511, "arp": 601, "icmp": 701}


def name_of(code, table: dict, default: str) -> Column:
    """Name of a code; the table becomes one constant map in the plan."""
    code = F.col(code) if isinstance(code, str) else code
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[code.cast("int")], F.lit(default))

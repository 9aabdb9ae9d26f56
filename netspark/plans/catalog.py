"""All registered queries."""

from netspark.plans import queries_apps, queries_bytes, queries_events, queries_flows, queries_nodes, queries_packets, queries_paths, queries_reports, queries_streaming, queries_streams  # noqa: F401
from netspark.plans.registry import ORACLES, QUERIES  # noqa: F401

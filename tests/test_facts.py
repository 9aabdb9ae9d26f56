"""Facts told by the columns of a report."""

import pytest
from pyspark.sql import functions as F

from helpers import packets
from netspark import schema as S
from netspark.operators import nodes


@pytest.fixture(scope="module")
def frames(spark):
    rows = [{"ts_us": (i % 3) * 30 * S.US, "src_mac": 2 + i % 4, "dst_mac": 9 if i % 5 else 0xFFFFFFFFFFFF, "vlan_id": i % 2, "wire_len": 60 + 90 * (i % 7),
             "eth_type": S.ETH_ARP if i % 6 == 0 else S.ETH_IPV4, "frag_offset": 5 if i % 11 == 0 else 0} for i in range(80)]
    return packets(spark, rows)


@pytest.mark.parametrize("by", [["mac", "l2_type"], ["mac", "dir", "size_rank"], nodes.NODE, nodes.L2_FACTS, nodes.L3_FACTS])
def test_coarse_facts_are_sums_of_the_finest(frames, by):
    sums = [nodes.total(c).alias(c) for c in ("packets", "bytes", "l3_bytes", "l4_bytes")]
    got = nodes.node_facts(frames, by=by)
    assert got.columns[:len(by)] == by and got.groupBy(*by).count().filter(F.col("count") > 1).isEmpty()
    want = nodes.node_facts(frames).groupBy(*by).agg(*sums)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("report, by", [(nodes.node_l2, nodes.L2_FACTS), (nodes.node_l3, nodes.L3_FACTS), (nodes.node_levels, nodes.NODE), (nodes.node_registry, nodes.NODE)])
def test_reports_of_coarse_facts(frames, report, by):
    assert sorted(map(str, report(nodes.node_facts(frames, by=by)).collect())) == sorted(map(str, report(nodes.node_facts(frames)).collect()))

"""Sinks and capture numbering."""

import os
import struct

import pytest

from netspark.session import work_dir
from netspark.sources import captures, sinks

S = 1_000_000


def test_a_run_over_half_an_hour_keeps_the_other_windows(spark, tmp_path):
    rows = [(w * 30 * S, "m", w) for w in range(120)]
    frame = lambda part: spark.createDataFrame(part, "window_us BIGINT, metric STRING, count BIGINT")
    path = str(tmp_path / "metrics")
    sinks.write_metrics(frame(rows[:60]), path)
    sinks.write_metrics(frame(rows[60:]), path)
    sinks.write_metrics(frame(rows[60:]), path)
    got = sorted((r.window_us, r["count"]) for r in spark.read.parquet(path).collect())
    assert got == [(w, n) for w, _, n in rows]


def test_a_repeated_run_of_events_stands_once(spark, tmp_path):
    frame = lambda part: spark.createDataFrame(part, "event_code INT, at_us BIGINT, bytes BIGINT")
    path = str(tmp_path / "events")
    for run, rows in (("10h", [(101, 1, 5), (102, 2, 6)]), ("11h", [(101, 3, 7)]), ("10h", [(101, 1, 5), (102, 2, 6)])):
        sinks.write_events(frame(rows), path, run)
    assert sorted((r.event_code, r.at_us, r.bytes) for r in spark.read.parquet(path).collect()) == [(101, 1, 5), (101, 3, 7), (102, 2, 6)]


def test_packet_ids_are_unique_and_follow_files(spark, tmp_path):
    for hour in range(12):
        body = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
        body += b"".join(struct.pack("<IIII", 1000 * hour + i, 0, 4, 60) + b"abcd" for i in range(5))
        (tmp_path / f"cap-{hour:02d}.pcap").write_bytes(body)
    rows = captures.number_packets(captures.read_captures(spark, str(tmp_path))).select("packet_id", "ts_us").orderBy("packet_id").collect()
    assert len({r.packet_id for r in rows}) == 60
    assert [r.ts_us for r in rows] == sorted(r.ts_us for r in rows)


def test_work_folder_comes_from_settings(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    with pytest.raises(ValueError):
        captures.shared(type("Cluster", (), {"sparkContext": type("C", (), {"master": "yarn"})}), "/data/captures")


def test_steps_and_nulls_keep_the_other_windows(spark, tmp_path, monkeypatch):
    """In several steps, with rows and old rows of no window, and windows of which some rows are gone in the new run."""
    monkeypatch.setattr(sinks, "SLICE_ROWS", 40, raising=False)
    frame = lambda part: spark.createDataFrame(part, "window_us BIGINT, metric STRING, count BIGINT")
    path, rows = str(tmp_path / "metrics"), [(w * 300 * S, m, w) for w in range(400) for m in "ab"] + [(None, "a", 7), (None, "a", 7)]
    sinks.write_metrics(frame(rows), path)
    again = [(w, m, n + 1000) for w, m, n in rows if w is not None and 100 <= n < 250 and m == "a"]
    sinks.write_metrics(frame(again), path)
    gone = {w for w, _, _ in again}
    want = [*again, *(r for r in rows if r[0] not in gone)]
    got = [tuple(r) for r in spark.read.parquet(path).select("window_us", "metric", "count").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_run_holds_no_copy_of_its_rows_in_checkpoints(spark, tmp_path, monkeypatch):
    """New and kept rows are not checkpointed, only the windows; what is stored for the run goes with it."""
    cuts, stages = [], []
    monkeypatch.setattr(sinks, "cut", lambda df: (cuts.append(df.columns), df.cache())[1])
    store = getattr(sinks, "store", None)
    monkeypatch.setattr(sinks, "store", lambda rows, at: (stages.append(at), store(rows, at))[1], raising=False)
    frame = lambda part: spark.createDataFrame(part, "window_us BIGINT, metric STRING, count BIGINT")
    for _ in range(2):
        sinks.write_metrics(frame([(w * 30 * S, "m", w) for w in range(200)]), str(tmp_path / "metrics"))
    assert cuts == [["window_us", "day", "hour"]]
    assert len(stages) == 2 and not any(os.path.exists(s) for s in stages)


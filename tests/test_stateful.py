"""Retries and log windows: state over several starts of a stream."""

from collections import Counter
from datetime import datetime, timedelta

import pytest

from plumbline.streaming import stateful as T

T0 = datetime(2026, 1, 1)
OUTCOME = "file_id long, attempt_id long, at timestamp, error string, retryable boolean"
ENTRY = "fileId long, entry string, at timestamp, message string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


class Drops:
    """A folder that gets rows, and a stream that is started again for each."""

    def __init__(self, spark, path, ddl, make):
        self.spark, self.path, self.ddl, self.make = spark, str(path), ddl, make

    def __call__(self, rows):
        self.spark.createDataFrame(rows, self.ddl).coalesce(1).write.mode("append").parquet(f"{self.path}/drop")
        stream = self.spark.readStream.schema(self.ddl).parquet(f"{self.path}/drop")
        T.write_batches(self.make(stream), f"{self.path}/out", f"{self.path}/check").awaitTermination()


def test_retries_over_restarts(spark, tmp_path):
    drop = Drops(spark, tmp_path, OUTCOME, lambda s: T.retry_states(s, most=2, delay="5 minutes", late="0 seconds"))

    def states():
        return {r.file_id: (r.status, r.attempts, r.error) for r in T.latest_states(spark, f"{tmp_path}/out").collect()}

    drop([(1, 1, at(0), None, None), (2, 1, at(0), "kaputt", False), (3, 1, at(0), "timeout", True), (4, 1, at(1), "timeout", True)])
    assert states() == {1: ("done", 1, None), 2: ("failed", 1, "kaputt"), 3: ("waiting", 1, "timeout"), 4: ("waiting", 1, "timeout")}
    # time goes on: both are due; 2 is settled and stays so
    drop([(9, 1, at(20), None, None), (2, 2, at(20), None, None)])
    drop([(9, 2, at(21), None, None)])
    assert states()[3][:2] == states()[4][:2] == ("due", 1) and states()[2] == ("failed", 1, "kaputt")
    assert {r.file_id for r in T.to_process(spark, f"{tmp_path}/out").collect()} == {3, 4}
    drop([(3, 2, at(22), None, None), (4, 2, at(22), "timeout", True), (4, 3, at(23), "weg", True)])
    assert states()[3] == ("done", 2, None) and states()[4] == ("given up", 3, "weg")
    before = spark.read.parquet(f"{tmp_path}/out").count()
    drop([(9, 3, at(60), None, None)])  # no timer is left, and nothing is returned again
    drop([(9, 4, at(61), None, None)])
    assert spark.read.parquet(f"{tmp_path}/out").count() == before


def test_log_windows_count_entries_once_and_lose_none(spark, tmp_path):
    drop = Drops(spark, tmp_path, ENTRY, lambda s: T.log_windows(s, "1 minute", "5 minutes"))
    first = [(7, "a", at(0), "Error: x"), (7, "b", at(0.5), "ok"), (7, "c", at(2), "warn"), (8, "a", at(0), "failed")]
    drop(first)
    drop([*first, (7, "d", at(0.9), "late but open"), (7, "a", at(0), "Error: x")])  # saved again
    drop([(7, "e", at(30), "far on")])
    drop([(7, "f", at(0.1), "too late"), (7, None, None, None), (8, "b", at(0.2), "ok")])
    counts = {(r.fileId, r.window_start): (r.total, r.errors, r.warnings, r.closed) for r in T.window_counts(spark, f"{tmp_path}/out").collect()}
    assert counts == {(7, at(0)): (3, 1, 0, True), (7, at(2)): (1, 0, 1, True), (7, at(30)): (1, 0, 0, False), (8, at(0)): (2, 1, 0, False)}
    assert Counter((r.fileId, r.entry, r.message) for r in T.late_entries(spark, f"{tmp_path}/out").collect()) == Counter([(7, "f", "too late"), (7, None, None)])


def test_state_of_a_long_log_stays_flat(spark, tmp_path):
    """Many batches of one endless log: the state holds its open windows only."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    for k in range(40):
        spark.createDataFrame([(1, f"e{k}-{i}", at(k + i / 10), "ok") for i in range(5)], ENTRY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/drop")
    stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/drop")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        query = T.write_batches(T.log_windows(stream, "1 minute", "3 minutes"), f"{tmp_path}/out", f"{tmp_path}/check")
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert len(rows) == 40 and max(rows[10:]) <= max(rows[:10]) + 12
    assert T.window_counts(spark, f"{tmp_path}/out").agg({"total": "sum"}).first()[0] == 200


@pytest.mark.parametrize("make", [T.log_windows])
def test_empty_stream(spark, tmp_path, make):
    spark.createDataFrame([], ENTRY).write.parquet(f"{tmp_path}/drop")
    stream = spark.readStream.schema(ENTRY).parquet(f"{tmp_path}/drop")
    T.write_batches(make(stream), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()


def test_state_rows_do_not_grow_with_the_files(spark, tmp_path):
    """Many files and logs share state rows; rows without a file are one, and ids stay whole beside them."""
    n, big = T.BUCKETS + 500, (1 << 53) + 1
    ids = [None, big, big + 1, *range(n)]
    spark.createDataFrame([(k, 1, at(0), "timeout", True) for k in ids] + [(big, 2, at(1), None, None)], OUTCOME).coalesce(1).write.parquet(f"{tmp_path}/a/drop")
    spark.createDataFrame([(k, "e", at(0), "Error: x") for k in ids] + [(big, "e", at(0), "Error: x")], ENTRY).coalesce(1).write.parquet(f"{tmp_path}/b/drop")
    done = {}
    for name, ddl, make in (("a", OUTCOME, lambda s: T.retry_states(s, 2, "5 minutes", "0 seconds")), ("b", ENTRY, lambda s: T.log_windows(s, "1 minute", "5 minutes"))):
        stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/{name}/drop")
        query = T.write_batches(make(stream), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/check")
        query.awaitTermination()
        done[name] = max(p["stateOperators"][0]["customMetrics"].get("numValueStateVars", 0) and p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
    # a state row and a timer with its index, by bucket
    assert 0 < done["a"] <= 3 * T.BUCKETS and 0 < done["b"] <= T.BUCKETS
    states = {r.file_id: (r.status, r.attempts) for r in T.latest_states(spark, f"{tmp_path}/a/out").collect()}
    assert len(states) == len(ids) and states[big] == ("done", 2) and states[big + 1] == states[None] == ("waiting", 1)
    assert sorted((r.fileId is None, r.fileId or 0, r.total) for r in T.window_counts(spark, f"{tmp_path}/b/out").collect()) == sorted((k is None, k or 0, 1) for k in ids)

"""Keyed state with a bounded size: retries of failed files, and event-log windows that close."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline.plans import lifecycle

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Files share a state row with all files of their bucket: a call and a read of the state take milliseconds, whatever they hold.
BUCKETS = 1 << 11


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def use_keyed_state(spark: SparkSession) -> None:
    """State with timers needs this store."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


# --- failed files and their retries -----------------------------------------------------

RETRY = "file_id bigint, status string, attempts int, error string, at timestamp, next_at timestamp"


_SETTLED = ("done", "failed", "given up")


class _Retries(StatefulProcessor):
    """State of the files of a bucket: attempts, last error, when each is tried again, and whether that is over.

    One timer a bucket: it stands for the next file that becomes due.
    """

    def __init__(self, most: int, delay_ms: int):
        self.most, self.delay = most, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "files", "file_id array<bigint>, status array<string>, attempts array<int>, error array<string>, at array<bigint>, next_at array<bigint>, timer bigint")

    def _load(self) -> tuple[dict, int | None]:
        if not self.state.exists():
            return {}, None
        *columns, timer = self.state.get()
        ids, *rest = columns
        return dict(zip(ids, zip(*rest, strict=True), strict=True)), timer

    def _save(self, files: dict, timer: int | None) -> None:
        """Store the files, and set the timer to the first that waits."""
        first = min((f[4] for f in files.values() if f[0] == "waiting" and f[4] is not None), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.state.update((list(files), *(list(c) for c in zip(*files.values(), strict=True)), first))

    def _rows(self, files: dict, ids: Sequence) -> pd.DataFrame:
        columns = list(zip(*(files[k] for k in ids), strict=True))
        times = {name: pd.to_datetime(pd.Series(columns[i], dtype="Int64"), unit="ms").astype("datetime64[ms]") for name, i in (("at", 3), ("next_at", 4))}
        return pd.DataFrame({"file_id": pd.Series(ids, dtype="Int64"), "status": columns[0], "attempts": columns[1],
                             "error": pd.Series(columns[2], dtype=object)} | times)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        files, timer = self._load()
        found = pd.concat(list(rows)).sort_values(["at", "attempt_id"])
        ms = [None if pd.isna(x) else int(x) for x in (found["at"] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)]
        changed = {}
        for file_id, nameless, at, failure, again in zip(found["file_id"].tolist(), found["nameless"].tolist(), ms, found["error"], found["retryable"], strict=True):
            file_id = None if nameless else file_id
            status, attempts = files[file_id][:2] if file_id in files else ("new", 0)
            if status in _SETTLED:
                continue  # what is settled stays settled
            attempts, error, next_at = attempts + 1, (None if pd.isna(failure) else failure), None
            if error is None:
                status = "done"
            elif not again:
                status = "failed"
            elif attempts > self.most:
                status = "given up"
            else:
                status, next_at = "waiting", None if at is None else at + self.delay
            files[file_id] = (status, attempts, error, at, next_at)
            changed[file_id] = True
        if changed:
            self._save(files, timer)
            yield self._rows(files, list(changed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        files, timer = self._load()
        passed = expiredTimerInfo.getExpiryTimeInMs()
        if passed != timer:
            return
        passed = max(passed, timerValues.getCurrentWatermarkInMs() - 1)
        due = [k for k, f in files.items() if f[0] == "waiting" and f[4] is not None and f[4] <= passed]
        for k in due:
            files[k] = ("due", *files[k][1:])
        self._save(files, None)  # the timer that went off is gone
        yield self._rows(files, due)

    def close(self) -> None:
        pass


def retry_states(outcomes: DataFrame, most: int = 3, delay: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """RETRY rows of a stream: a file's state whenever an attempt changes it, and `due` when its next attempt is.

    outcomes: file_id, attempt_id, at, error (null: it worked), retryable. A failure that may pass is tried again
    `delay` later, at most `most` times, then the file is given up; any other failure ends it at once and stays as
    pending with its error. A file that is settled takes no further outcome. `due` comes once the watermark of the
    outcomes, `late` behind them, has passed the time. Attempts of a file take effect in the order of at and
    attempt_id within a batch, those without a time last. Rows without file_id are one file. The state holds one
    entry a file, in BUCKETS rows at most.
    """
    use_keyed_state(outcomes.sparkSession)
    delay_ms = int(pd.Timedelta(delay).total_seconds() * 1000)
    file_id = F.col("file_id").cast("long")
    # without nulls the ids stay whole numbers in pandas
    rows = outcomes.select(_bucket(file_id), F.coalesce(file_id, F.lit(0)).alias("file_id"), file_id.isNull().alias("nameless"),
                           F.coalesce(F.col("attempt_id").cast("long"), F.lit((1 << 63) - 1)).alias("attempt_id"), "at", "error",
                           F.coalesce("retryable", F.lit(False)).alias("retryable")).withWatermark("at", late)
    return rows.groupBy("bucket").transformWithStateInPandas(_Retries(most, delay_ms), RETRY, "Update", "EventTime")


def write_batches(rows: DataFrame, out: str, checkpoint: str, mode: str = "update", partition: str | None = None) -> StreamingQuery:
    """Write each batch of a stream to a folder of its own, which a batch that is run again overwrites; stops when all is read."""
    def step(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{out}/batch={batch_id}")

    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()


def latest_states(spark: SparkSession, out: str) -> DataFrame:
    """The last RETRY row of each file: a settled status, `waiting`, or `due`."""
    rows = spark.read.schema(f"{RETRY}, batch bigint").parquet(out)
    order = F.struct("batch", (F.col("status") == "due").alias("due"))
    fields = [c for c in rows.columns if c not in ("file_id", "batch")]
    return rows.groupBy("file_id").agg(F.max_by(F.struct(*fields), order).alias("s")).select("file_id", "s.*")


def to_process(spark: SparkSession, out: str) -> DataFrame:
    """Files that are to be tried again now."""
    return latest_states(spark, out).filter("status = 'due'").select("file_id", "attempts", "error")


# --- event-log windows that close --------------------------------------------------------

LOG_ROW = ("kind string, fileId bigint, window_start timestamp, total bigint, errors bigint, warnings bigint, closed boolean, "
           "entry string, at timestamp, message string")


class _Windows(StatefulProcessor):
    """State of the logs of a bucket: each log's newest time, and its open windows with their counts and the entries seen in them."""

    def __init__(self, window_ms: int, late_ms: int):
        self.window, self.late = window_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("logs", "file_id array<bigint>, newest array<bigint>, of array<bigint>, start array<bigint>, total array<bigint>, "
                                          "errors array<bigint>, warnings array<bigint>, entries array<array<string>>")

    def _load(self) -> tuple[dict, dict]:
        """Newest time by log, and by log and start of an open window its total, errors, warnings and entries."""
        if not self.state.exists():
            return {}, {}
        ids, newest, of, start, *values = self.state.get()
        return dict(zip(ids, newest, strict=True)), {
            k: [*v[:3], dict.fromkeys(v[3])] for k, v in zip(zip(of, start, strict=True), zip(*values, strict=True), strict=True)}

    def _save(self, newest: dict, windows: dict) -> None:
        values = ([w[k] for w in windows.values()] for k in range(3))
        self.state.update((list(newest), list(newest.values()), [k[0] for k in windows], [k[1] for k in windows], *values, [list(w[3]) for w in windows.values()]))

    def _rows(self, late: Sequence[tuple], counts: Sequence[tuple]) -> pd.DataFrame:
        """late: file, start, entry, at, message. counts: file, start, total, errors, warnings, closed."""
        none, gone = [None] * len(late), [None] * len(counts)
        numbers = {name: pd.Series(none + [c[k] for c in counts], dtype="Int64") for k, name in enumerate(("total", "errors", "warnings"), 2)}
        return pd.DataFrame({
            "kind": ["late"] * len(late) + ["count"] * len(counts), "fileId": pd.Series([r[0] for r in [*late, *counts]], dtype="Int64"),
            "window_start": pd.to_datetime([r[1] for r in [*late, *counts]], unit="ms"), **numbers, "closed": [True] * len(late) + [c[5] for c in counts],
            "entry": pd.Series([r[2] for r in late] + gone, dtype=object), "at": pd.Series([r[3] for r in late] + gone, dtype="datetime64[us]"),
            "message": pd.Series([r[4] for r in late] + gone, dtype=object)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, windows = self._load()
        newest, late, touched = dict(before), [], {}
        found = pd.concat(list(rows))
        ms = (found["at"] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)
        found = found.assign(ms=ms, start=ms - ms % self.window).sort_values(["ms", "entry"])
        columns = [found[c].tolist() for c in ("fileId", "nameless", "ms", "start", "entry", "is_error", "is_warning")]
        for file_id, nameless, when, start, entry, bad, warn, at, message in zip(*columns, found["at"], found["message"], strict=True):
            file_id = None if nameless else file_id
            if file_id in before and start + self.window <= before[file_id] - self.late:
                late.append((file_id, start, entry, at, message))
                continue
            newest[file_id] = max(when, newest.get(file_id, when))
            window = windows.setdefault((file_id, start), [0, 0, 0, {}])
            touched[file_id, start] = True
            if entry in window[3]:
                continue  # saved again
            window[3][entry] = None
            window[0], window[1], window[2] = window[0] + 1, window[1] + int(bad), window[2] + int(warn)
        closed = {k for k in windows if k[1] + self.window <= newest[k[0]] - self.late}
        counts = [(*k, *w[:3], k in closed) for k, w in windows.items() if k in touched or k in closed]
        self._save(newest, {k: w for k, w in windows.items() if k not in closed})
        if late or counts:
            yield self._rows(late, counts)

    def close(self) -> None:
        pass


def log_windows(entries: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """LOG_ROW rows of a stream of log entries (fileId, at, message, entry): counts by window, each entry once.

    `entry` names an entry of the log: one that is saved again is not counted again while its window is open. Rows of
    kind `count` hold a window's counts so far, the last one with `closed`; a window closes when its log has gone on
    `late` beyond it. Rows of kind `late` are entries whose window is closed, with all their fields: none is lost.
    The state of a log is its newest time, its open windows and their entries, whatever its length; logs share BUCKETS rows. Times are the log's own: one log
    that is ahead makes no entry of another late. Entries without a time are taken for the oldest.
    """
    use_keyed_state(entries.sparkSession)
    sizes = [int(pd.Timedelta(x).total_seconds() * 1000) for x in (window, late)]
    message = F.col("message")
    file_id = F.col("fileId").cast("long")
    rows = entries.select(_bucket(file_id), F.coalesce(file_id, F.lit(0)).alias("fileId"), file_id.isNull().alias("nameless"), F.coalesce("at", F.lit(0).cast("timestamp")).alias("at"), message, F.col("entry").cast("string").alias("entry"),
                          F.coalesce(lifecycle.is_error(message), F.lit(False)).alias("is_error"), F.coalesce(lifecycle.is_warning(message), F.lit(False)).alias("is_warning"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Windows(*sizes), LOG_ROW, "Update", "None")


def window_counts(spark: SparkSession, out: str) -> DataFrame:
    """The last counts of each window that write_batches has written."""
    rows = spark.read.schema(f"{LOG_ROW}, batch bigint").parquet(out).filter("kind = 'count'")
    last = F.max_by(F.struct("total", "errors", "warnings", "closed"), F.struct("batch", "closed"))
    return rows.groupBy("fileId", "window_start").agg(last.alias("v")).select("fileId", "window_start", "v.*")


def late_entries(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{LOG_ROW}, batch bigint").parquet(out).filter("kind = 'late'").select("fileId", "entry", "at", "message")

"""Fold of fetch outcomes with timers, and a filter of unchanged pages: keyed state by transformWithState.

The state store is RocksDB (`with_keyed_state`): state lies on the executors' disks with changelogs in the checkpoint,
not in their memory. A key is a bucket of sources or bodies, whose rows are worked out together as arrays: a call for each
source costs milliseconds, however few its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from placeloom.operators.crawl import FAILED_AT

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Days after which no success comes late any more: failures before them are kept as a number only.
SETTLED_DAYS = 60
#: Days without an outcome (of wall-clock time) after which a source's state is forgotten.
FORGET_DAYS = 400
DAY = 86_400_000_000  # microseconds
#: Keys that sources and bodies are dealt to; it must stay the same as long as a checkpoint is used.
BUCKETS = 1_024
#: Columns of a source's head: outcomes seen, last success, latest outcome (microseconds), failures that are a number only, when it
#: was changed and when it is due (milliseconds).
HEAD = SOURCE, SEEN, OK_TS, OK_ID, LATEST, FOLDED, TOUCHED, DUE = range(8)
LEAST, NOT_DUE = int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max)


def with_keyed_state(spark: SparkSession) -> None:
    """Let the session's new streaming queries keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


HEALTH = "record string, source_id long, seen long, failures long, state string, wait_hours int, due_at timestamp"


def health_of(failures: int) -> tuple[str, int]:
    """State of a source, and hours until it is due again."""
    state = "source_failed" if failures >= FAILED_AT else "degraded" if failures else "healthy"
    return state, min(24, 2 ** min(failures, 4)) if failures else 24


class OutcomeFold(StatefulProcessor):
    """Failures since the last success of each source of a bucket, and a timer for the next fetch that is due.

    `heads` is one row of numbers for each source: its last success, counts, and when it is due. Each failure after that success
    is an entry of a list, so outcomes may come in any order: a late failure before it counts nothing, a late success
    clears what is before it. Failures older than `settled_days` before the latest outcome are folded into a number.
    A bucket's sources are folded together, so a micro-batch costs a call for each bucket, not for each source.
    """

    def __init__(self, settled_days: int = SETTLED_DAYS, forget_days: int = FORGET_DAYS):
        self.settled, self.forget = settled_days * DAY, forget_days * DAY // 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getValueState("heads", "heads binary", self.forget)
        self.failed = handle.getListState("failed", "source_id long, ts long, event_id long", self.forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        known, held, whole = self._held(now)
        parts, failed = [known], [held]
        for batch in rows:
            at = np.stack([batch["source_id"].to_numpy("int64"), batch["ts"].to_numpy("datetime64[us]").astype("int64"), batch["event_id"].to_numpy("int64")], axis=1)
            good = batch["success"].to_numpy(bool)
            came = np.zeros((len(at), len(HEAD)), np.int64)
            came[:, SOURCE], came[:, SEEN], came[:, LATEST], came[:, TOUCHED], came[:, DUE] = at[:, 0], 1, at[:, 1], now, NOT_DUE
            came[:, OK_TS], came[:, OK_ID] = np.where(good, at[:, 1], LEAST), np.where(good, at[:, 2], 0)
            parts.append(self._united(came))
            failed.append(at[~good])
        fresh = np.unique(np.concatenate([p[:, SOURCE] for p in parts[1:]]))
        heads, failed = self._united(np.concatenate(parts)), np.concatenate(failed)
        # failures that are folded already are older than any success that can still come
        before = np.searchsorted(heads[:, SOURCE], known[:, SOURCE])
        later = (heads[before, OK_TS] != known[:, OK_TS]) | (heads[before, OK_ID] != known[:, OK_ID])
        heads[before[later], FOLDED] = 0
        of = np.searchsorted(heads[:, SOURCE], failed[:, 0])
        after = (failed[:, 1] > heads[of, OK_TS]) | ((failed[:, 1] == heads[of, OK_TS]) & (failed[:, 2] > heads[of, OK_ID]))
        recent = after & (failed[:, 1] >= heads[of, LATEST] - self.settled)
        heads[:, FOLDED] += np.bincount(of[after & ~recent], minlength=len(heads))
        if not (whole and recent[: len(held)].all()):
            if recent.any():
                self.failed.put([tuple(f) for f in failed[recent].tolist()])
            else:
                self.failed.clear()
        elif recent[len(held) :].any():
            self.failed.appendList([tuple(f) for f in failed[len(held) :][recent[len(held) :]].tolist()])
        failures = heads[:, FOLDED] + np.bincount(of[recent], minlength=len(heads))
        is_fresh = np.isin(heads[:, SOURCE], fresh)
        wait = np.array([health_of(f)[1] for f in failures.tolist()], np.int64)
        heads[is_fresh, DUE] = (heads[:, LATEST] // 1000 + wait * 3_600_000)[is_fresh]
        self._keep(heads)
        yield self._rows("health", key, heads[is_fresh], failures[is_fresh])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        heads, failed, _ = self._held(now)
        due = heads[:, DUE] <= max(expiredTimerInfo.getExpiryTimeInMs(), now - 1)
        if due.any():
            failures = heads[:, FOLDED] + np.bincount(np.searchsorted(heads[:, SOURCE], failed[:, 0]), minlength=len(heads))
            yield self._rows("due", key, heads[due], failures[due])
            heads[due, DUE] = NOT_DUE
            self._keep(heads)

    def close(self) -> None:
        pass

    def _held(self, now: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Heads of the bucket's sources, in their order, and failures of these, without sources that are forgotten; if those are all in the list."""
        heads = np.frombuffer(bytes(self.heads.get()[0]) if self.heads.exists() else b"", np.int64).reshape(-1, len(HEAD))
        heads = heads[heads[:, TOUCHED] > now - self.forget]
        failed = np.array(list(self.failed.get()) if self.failed.exists() else [], np.int64).reshape(-1, 3)
        own = np.isin(failed[:, 0], heads[:, SOURCE])
        return heads.copy(), failed[own], bool(own.all())

    def _keep(self, heads: np.ndarray) -> None:
        self.heads.update((np.ascontiguousarray(heads).tobytes(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        first = int(heads[:, DUE].min())
        if first < NOT_DUE:
            self.handle.registerTimer(first)

    @staticmethod
    def _united(heads: np.ndarray) -> np.ndarray:
        """One row a source: the latest of times, the sum of counts."""
        heads = heads[np.lexsort((heads[:, OK_ID], heads[:, OK_TS], heads[:, SOURCE]))]
        starts = np.flatnonzero(np.concatenate(([True], heads[1:, SOURCE] != heads[:-1, SOURCE]))) if len(heads) else np.empty(0, np.int64)
        out = heads[np.append(starts[1:], len(heads)) - 1] if len(heads) else heads.copy()
        if len(out):
            for column, function in ((SEEN, np.add), (FOLDED, np.add), (LATEST, np.maximum), (TOUCHED, np.maximum), (DUE, np.minimum)):
                out[:, column] = function.reduceat(heads[:, column], starts)
        return out

    @staticmethod
    def _rows(record: str, key, heads: np.ndarray, failures: np.ndarray) -> pd.DataFrame:
        state = [health_of(f) for f in failures.tolist()]
        due = (heads[:, DUE] * 1000).astype("datetime64[us]") if record == "due" else np.full(len(heads), np.datetime64("NaT", "us"))
        source = pd.array(heads[:, SOURCE], "Int64") if key[0] >= 0 else pd.array([None] * len(heads), "Int64")
        return pd.DataFrame({"record": record, "source_id": source, "seen": heads[:, SEEN], "failures": failures, "state": [s for s, _ in state], "wait_hours": np.array([w for _, w in state], "int32"), "due_at": due})


def fold_outcomes(fetches: DataFrame, settled_days: int = SETTLED_DAYS) -> DataFrame:
    """Streaming (HEALTH) rows of each source from (source_id, ts, event_id, success).

    record health: a row for a source and micro-batch; of a source that with the most outcomes `seen` is the latest.
    record due: when a source's next fetch is due by the clock, `wait_hours` after its latest outcome, unless another
    outcome comes first; due_at is that time.
    """
    with_keyed_state(fetches.sparkSession)
    source = F.col("source_id").cast("long")
    # a null source is one of its own
    bucket = F.when(source.isNull(), -1).otherwise(F.pmod(F.xxhash64(source), F.lit(BUCKETS))).cast("int")
    columns = fetches.select(bucket.alias("bucket"), F.coalesce(source, F.lit(0)).alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.coalesce("success", F.lit(False)).alias("success"))
    return columns.groupBy("bucket").transformWithStateInPandas(OutcomeFold(settled_days), HEALTH, "Append", "ProcessingTime")


def drain_rows(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Run a stateful stream over all that is there now, appending to the Parquet folder `target`, and stop.

    Timers that are due fire in the batch of the last data. Batches without data, which a query that keeps running has
    for its timers, would never end here.
    """
    spark, conf = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(conf, before)


def latest_health(spark: SparkSession, target: str) -> DataFrame:
    """(source_id, failures, state, wait_hours) of every source that was ever folded into `target`."""
    rows = spark.read.schema(HEALTH).parquet(target).where("record = 'health'")
    latest = F.max_by(F.struct("failures", "state", "wait_hours"), "seen").alias("h")
    return rows.groupBy("source_id").agg(latest).select("source_id", "h.*")


def due_sources(spark: SparkSession, target: str) -> DataFrame:
    """(source_id, failures, due_at) of the sources that are due after the latest of their outcomes in `target`."""
    rows = spark.read.schema(HEALTH).parquet(target)
    latest = rows.groupBy("source_id").agg(F.max(F.when(F.col("record") == "health", F.col("seen"))).alias("all_seen"), F.max_by(F.struct("seen", "failures", "due_at"), F.when(F.col("record") == "due", F.col("seen"))).alias("due"))
    return latest.where("due.seen = all_seen").select("source_id", "due.failures", "due.due_at")


class ChangedPages(StatefulProcessor):
    """Which pages need an extraction: those whose body hasn't been extracted with success.

    A body is a source and a hash, as JSON; a key is a bucket of bodies, so a source with very many pages is no hot key. The
    state is a list of the bodies that are done, which only grows at its end.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getListState("done", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = pd.concat(list(rows), ignore_index=True)
        # in their order; a run before the pages of its instant
        every = every.sort_values(["body", "at", "page"], kind="stable", ignore_index=True)
        done = {body for (body,) in self.done.get()} if self.done.exists() else set()
        ran, pages = every["success"].to_numpy(bool), every["page"].to_numpy(bool)
        before = (every["success"].astype("int64").groupby(every["body"], sort=False).cumsum() > 0).to_numpy() | every["body"].isin(done).to_numpy()
        new = sorted(set(every["body"][ran]) - done)
        if new:
            self.done.appendList([(body,) for body in new])
        if pages.any():
            yield pd.DataFrame({"page_id": every["page_id"][pages].astype("int64"), "body": every["body"][pages], "action": np.where(before[pages], "skip", "extract")})

    def close(self) -> None:
        pass


def changed_pages(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Streaming (page_id, source_id, hash, action) of pages (page_id, source_id, hash, at) by runs (source_id, hash, success, at).

    action is skip where a successful run of the same body was seen before the page or in its micro-batch at its time at
    the latest, else extract: a failed run, or another body, changes nothing. Both inputs are streams; equal hashes of
    two sources are different bodies.
    """
    with_keyed_state(pages.sparkSession)
    body = F.to_json(F.struct(F.col("source_id").cast("long").alias("source_id"), "hash")).alias("body")
    seen = pages.select(body, "at", F.lit(True).alias("page"), F.col("page_id").cast("long").alias("page_id"), F.lit(False).alias("success"))
    ran = runs.select(body, "at", F.lit(False).alias("page"), F.lit(0).cast("long").alias("page_id"), F.coalesce("success", F.lit(False)).alias("success"))
    both = seen.unionByName(ran).withColumn("bucket", F.pmod(F.xxhash64("body"), F.lit(BUCKETS)).cast("int"))
    found = both.groupBy("bucket").transformWithStateInPandas(ChangedPages(), "page_id long, body string, action string", "Append", "None")
    return found.withColumn("body", F.from_json("body", "source_id long, hash string")).select("page_id", "body.source_id", "body.hash", "action")

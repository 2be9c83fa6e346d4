"""The event log as a stream: windows, sessions, repeat deferral, recapture, ageing by scan."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.runtime import partitions, shared_dir, ship

LIMIT, DEFER_S, FORGET_S = 2, 3 * 86400, 5 * 86400


def event_log(spark: SparkSession, path: str, schema, form: str = "parquet") -> DataFrame:
    """A stream of the file or the files below ``path``; of JSON lines those that can't be parsed are dropped."""
    reader = spark.readStream.schema(schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream's source has to be a folder
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.option("mode", "DROPMALFORMED").json(path) if form == "json" else reader.parquet(path)


def settled(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its last output, from a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def window_counts(events: DataFrame, kind: str, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    w = F.window("ts", width, slide or width)
    return events.withWatermark("ts", late).groupBy(w, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sessions(events: DataFrame, key: str, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s, key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


NEW = (0, -1.0, False, -1.0)


def defer(state: tuple[int, float, bool, float], now: float, limit: int = LIMIT, wait: float = DEFER_S, forget: float = FORGET_S) -> tuple[tuple[int, float, bool, float], bool]:
    """State (count, deferred until or -1, expired once, last seen) after an appearance, and whether it is shown.

    A finding is shown ``limit`` times, then put off for ``wait``. At its end it is shown and
    counted anew, once; the next deferral never ends. One that reports don't have for more than
    ``forget`` is forgotten: its next appearance is like its first.
    """
    count, until, again, seen = NEW if 0 <= state[3] < now - forget else state
    if until >= 0:
        if again or now < until:
            return (count, until, again, now), False
        count, until, again = 0, -1.0, True
    count += 1
    return (count, now + wait if count >= limit else -1.0, again, now), True


SHOWN = "user_id long, event_type string, event_id long, shown boolean"


def _shown(key, rows: pd.DataFrame, state) -> tuple[tuple, pd.DataFrame]:
    out = []
    for t, i in sorted(zip(rows["ts"].astype("int64") / 1e9 if rows["ts"].dtype.kind != "M" else rows["ts"].astype("datetime64[us]").astype("int64") / 1e6, rows["event_id"])):
        state, seen = defer(state, float(t))
        out.append((*key, i, seen))
    return state, pd.DataFrame(out, columns=["user_id", "event_type", "event_id", "shown"])


def deferred(events: DataFrame) -> DataFrame:
    """(user_id, event_type, event_id, shown) of a batch, each key's appearances in order of time."""
    ship(events.sparkSession)

    def run(batches):
        key, state = None, NEW
        for b in batches:
            shown = []
            for u, e, t in zip(b.column("user_id").to_pylist(), b.column("event_type").to_pylist(), b.column("t").to_pylist()):
                if key != (u, e):
                    key, state = (u, e), NEW
                state, seen = defer(state, t / 1e6)
                shown.append(seen)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("user_id", "event_type", "event_id")), pa.array(shown, pa.bool_())], ["user_id", "event_type", "event_id", "shown"])

    # a task goes through its keys one after the other, as a group of its own for each costs more than its rows
    rows = events.select("user_id", "event_type", "event_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(2**63))).alias("t"))
    rows = rows.repartition(partitions(events.sparkSession), "user_id", "event_type").sortWithinPartitions("user_id", "event_type", "t", "event_id")
    return rows.mapInArrow(run, SHOWN)


def deferred_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same over a stream, with the state of each key in the state store until the watermark is past its being forgotten."""
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, out = _shown(key, pd.concat(list(batches)), tuple(state.get) if state.exists else NEW)
        state.update(held)
        state.setTimeoutTimestamp(max(int((held[3] + FORGET_S) * 1000) + 1000, state.getCurrentWatermarkMs() + 1000))
        yield out

    rows = events.select("user_id", "event_type", "event_id", "ts").withWatermark("ts", late).groupBy("user_id", "event_type")
    return rows.applyInPandasWithState(step, SHOWN, "count int, until double, again boolean, seen double", "append", GroupStateTimeout.EventTimeTimeout)


def recapture(changed: DataFrame, scan: Callable[[DataFrame, int], None], every: str = "30 seconds", checkpoint: str | None = None):
    """Start a query that hands each micro-batch of changed (root, branch, generation) to ``scan``.

    Requests of a root that come in together are one, the newest generation; a null branch is skipped.
    """
    spark = changed.sparkSession

    def batch(df: DataFrame, epoch: int) -> None:
        scan(df.where("branch is not null").groupBy("root", "branch").agg(F.max("generation").alias("generation")), epoch)

    where = checkpoint or f"{shared_dir(spark)}/recapture-{uuid.uuid4().hex}"
    return changed.writeStream.option("checkpointLocation", where).foreachBatch(batch).trigger(processingTime=every).start()

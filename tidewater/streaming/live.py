"""Live versions of the metrics as Structured Streaming jobs."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.operators.taskstate import lease_s
from tidewater.session import checkpoint_dir

# Hours until a task is overdue, by tier.
DEADLINE_HOURS = {"low": 3, "medium": 4, "high": 8}


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its Parquet files, be it a folder of part files or a single file."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def hardware_windows(samples: DataFrame, metrics: list[str], width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Tumbling roll-up per task; rows later than the watermark are dropped."""
    cols = []
    for m in metrics:
        cols += [F.bround(F.avg(m), 2).alias(f"{m}_avg"), F.bround(F.max(m), 2).alias(f"{m}_max"), F.bround(F.min(m), 2).alias(f"{m}_min")]
    out = samples.withWatermark("at", lateness).groupBy(F.window("at", width), "task_id").agg(*cols, F.count(F.lit(1)).alias("n_samples"))
    return out.select(F.unix_seconds("window.start").alias("window_start_s"), "task_id", *[c for c in out.columns if c not in ("window", "task_id")])


def running_outcomes(log: DataFrame, width: str = "1 hour", lateness: str = "12 hours") -> DataFrame:
    """Successes and failures so far per task and suite.

    ``started_at`` is the start of a row's task, the same for all its rows, so a task lies in one window of starts. Once starts are
    ``lateness`` past a window, which is longer than any task may run, its counts are final and leave the state.
    """
    tasks = log.withWatermark("started_at", lateness).groupBy("task_id", "suite", F.window("started_at", width))
    return tasks.agg(F.count_if("success").alias("n_success"), F.count_if(~F.col("success")).alias("n_failed")).drop("window")


ALARM_SCHEMA = "task_id bigint, tier string, started_at timestamp, deadline_at timestamp, spent_s double, n_runs bigint"
# Open tasks are kept in this many states by a hash of the task: a call for each task would cost more than the work.
TASK_GROUPS = 1 << 10
_RUNNING_SCHEMA = "running binary"
_NEVER = 2**63 - 1
_OPEN = np.dtype([("task", "i8"), ("named", "?"), ("tier", "i8"), ("started", "i8"), ("deadline", "i8"), ("spent", "f8"), ("runs", "i8")])


def _alarm(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Alarms and open tasks of one group; all its tasks are worked on together."""
    tiers, watermark = list(DEADLINE_HOURS), state.getCurrentWatermarkMs()
    running = np.frombuffer(bytes(state.get[0]), _OPEN) if state.exists else np.zeros(0, _OPEN)
    if state.hasTimedOut:
        silent = np.ones(len(running), bool)
    else:
        seen = pd.concat([batch[["task", "named", "tier", "at_us", "ended_us", "exec_ms"]] for batch in batches], ignore_index=True)
        seen["tier"] = [tiers.index(t) for t in seen["tier"]]
        known = pd.DataFrame({n: running[n] for n in ("task", "named", "tier")} | {"at_us": running["started"], "ended_us": _NEVER, "exec_ms": running["spent"], "runs": running["runs"], "fresh": 0})
        every = pd.concat([known, seen.assign(runs=1, fresh=1)], ignore_index=True)
        tasks = every.groupby(["task", "named"], sort=False).agg(tier=("tier", "first"), started=("at_us", "min"), ended=("ended_us", "min"), spent=("exec_ms", "sum"), runs=("runs", "sum"), fresh=("fresh", "sum")).reset_index()
        hours = np.array([DEADLINE_HOURS[t] * 3_600_000_000 for t in tiers], np.int64)[tasks["tier"].to_numpy(np.int64)]
        started = tasks["started"].to_numpy(np.int64)
        tasks["deadline"] = np.where(started == _NEVER, _NEVER, started + np.where(started == _NEVER, 0, hours))
        still = (tasks["ended"] == _NEVER) | (tasks["ended"] > tasks["deadline"])
        running = np.zeros(int(still.sum()), _OPEN)
        for name in _OPEN.names:
            running[name] = tasks.loc[still, name].to_numpy()
        silent = tasks.loc[still, "fresh"].to_numpy() == 0
    # a group that always has rows would never time out: alarms of tasks without rows in this batch don't wait for that
    due = silent & (running["deadline"] // 1000 < watermark)
    late, running = running[due], running[~due]
    if len(late):
        ids = pd.array(late["task"], dtype="Int64")
        ids[~late["named"]] = pd.NA
        times = {n: pd.to_datetime(late[of], unit="us") for n, of in (("started_at", "started"), ("deadline_at", "deadline"))}
        yield pd.DataFrame({"task_id": ids, "tier": [tiers[i] for i in late["tier"]], **times, "spent_s": [round(float(x) / 1000, 3) for x in late["spent"]], "n_runs": late["runs"]})
    if len(running):
        state.update((running.tobytes(),))
        state.setTimeoutTimestamp(max(int(running["deadline"].min()) // 1000, watermark + 1))
    elif state.exists:
        state.remove()


def overdue(log: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """An alarm for each task that has not finished when its tier's deadline passes, counted from its first row.

    A timer on event time raises it, whether or not the task reports again. The state of a task ends with its alarm or with the row
    that finishes it in time; rows that come later than the watermark are dropped. Tasks share states by a hash, in which each stands
    for itself; the timer of a state is that of its first deadline.
    """
    at = F.coalesce(F.unix_micros("at"), F.lit(_NEVER))
    rows = log.withWatermark("at", lateness).select(
        F.pmod(F.xxhash64("task_id"), F.lit(TASK_GROUPS)).alias("group"), F.coalesce("task_id", F.lit(0).cast("long")).alias("task"), F.col("task_id").isNotNull().alias("named"),
        "tier", "at", at.alias("at_us"), F.when(F.col("finished"), at).otherwise(F.lit(_NEVER)).alias("ended_us"), F.coalesce(F.col("exec_ms").cast("double"), F.lit(0.0)).alias("exec_ms"),
    )
    return rows.groupBy("group").applyInPandasWithState(_alarm, ALARM_SCHEMA, _RUNNING_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def recent_load(samples: DataFrame, metric: str, width: str = "10 seconds", step: str = "2 seconds", lateness: str = "1 minute") -> DataFrame:
    """Sliding mean of a metric over all tasks."""
    out = samples.withWatermark("at", lateness).groupBy(F.window("at", width, step)).agg(F.bround(F.avg(metric), 2).alias("load"), F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_seconds("window.start").alias("window_start_s"), "load", "n")


STALE_SCHEMA = "id bigint, tier string, claimed_at timestamp, expired_at timestamp"
_CLAIM_SCHEMA = "tier string, claimed_us bigint, lease_us bigint"


def _expire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        tier, claimed, lease = state.get
        state.remove()
        yield pd.DataFrame({"id": [key[0]], "tier": [tier], "claimed_at": [pd.Timestamp(claimed, unit="us")], "expired_at": [pd.Timestamp(claimed + lease, unit="us")]})
        return
    # only the last change of a task matters: one row is kept whatever the batch holds
    last = None
    for batch in batches:
        row = batch.sort_values(["at_us", "change_id"]).iloc[-1]
        if last is None or (row.at_us, row.change_id) > (last.at_us, last.change_id):
            last = row
    if last is None:
        return
    if last.status == "running":
        state.update((last.tier, int(last.at_us), int(last.lease_us)))
        state.setTimeoutTimestamp(max(int((last.at_us + last.lease_us) // 1000), state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()


def stale_claims(changes: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Claims that outlived their lease without another change; state ends with the claim."""
    rows = changes.withWatermark("at", lateness).select(
        "id", "tier", "status", "change_id", "at", F.unix_micros("at").alias("at_us"), (lease_s() * 1e6).cast("bigint").alias("lease_us")
    )
    return rows.groupBy("id").applyInPandasWithState(_expire, STALE_SCHEMA, _CLAIM_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Process what is there, keep the last version of every key, return it as a table.

    Each micro-batch is written under its own number, so a repeated batch
    overwrites itself and the result is exactly once.
    """
    spark = stream.sparkSession
    base = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    declared = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    # a stream without data has stored no batch
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{base}/out/batch=-1")
    out = spark.read.schema(declared).option("basePath", f"{base}/out").parquet(f"{base}/out/batch=*")
    rest = [c for c in out.columns if c not in keys and c != "batch"]
    latest = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return latest.select(*keys, "_r.*")

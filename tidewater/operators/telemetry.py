"""Hardware telemetry: per-task roll-ups of samples, sensors, energy and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALARS = ("cpu_percent", "cpu_freq_mhz", "cpu_temp_tctl_c", "mem_used_gb", "mem_percent", "disk_read_mb_s", "disk_write_mb_s", "gpu_edge_c", "gpu_junction_c", "gpu_mem_c")
# array column -> (sensor prefix, index of its first element)
SENSORS = {"cpu_temp_cores_c": ("cpu_core", 0), "nvme_temps_c": ("nvme", 1), "ram_temps_c": ("ram", 1)}


def scalar_stats(samples: DataFrame, metrics=SCALARS) -> DataFrame:
    """Average, greatest and least of each metric per task; NULLs do not count."""
    cols = []
    for m in metrics:
        cols += [F.bround(F.avg(m), 2).alias(f"{m}_avg"), F.bround(F.max(m), 2).alias(f"{m}_max"), F.bround(F.min(m), 2).alias(f"{m}_min")]
    return samples.groupBy("task_id").agg(*cols)


def sensor_stats(samples: DataFrame) -> DataFrame:
    """One row per task and sensor position of the temperature arrays."""
    packed = F.array(*[F.struct(F.lit(p).alias("kind"), F.lit(first).alias("first"), F.col(c).alias("temps")) for c, (p, first) in SENSORS.items()])
    kinds = samples.select("task_id", F.explode(packed).alias("s")).select("task_id", "s.kind", "s.first", F.posexplode("s.temps").alias("pos", "temp"))
    named = kinds.where("temp is not null").withColumn("sensor", F.concat("kind", (F.col("pos") + F.col("first")).cast("string")))
    return named.groupBy("task_id", "sensor").agg(F.bround(F.avg("temp"), 2).alias("temp_avg_c"), F.bround(F.max("temp"), 2).alias("temp_max_c"))


def energy(samples: DataFrame, counter_max: float, at: str = "timestamp_s") -> DataFrame:
    """Energy and mean power from a counter that wraps at ``counter_max``."""
    seen = F.col("rapl_energy_uj").isNotNull()
    out = samples.groupBy("task_id").agg(
        F.min_by("rapl_energy_uj", F.when(seen, F.col(at))).alias("_first"),
        F.max_by("rapl_energy_uj", F.when(seen, F.col(at))).alias("_last"),
        F.count("rapl_energy_uj").alias("_readings"),
        (F.max(at) - F.min(at)).alias("_span"),
    )
    delta = F.expr(f"cast(case when _last >= _first then _last - _first else {counter_max} - _first + _last end as double)")
    return out.where("_readings >= 2").select(
        "task_id",
        F.bround(delta / 1e6, 3).alias("rapl_energy_total_j"),
        F.bround(delta / F.greatest(F.col("_span"), F.lit(0.001)) / 1e6, 2).alias("rapl_avg_power_w"),
    )


def duration(samples: DataFrame, at: str = "timestamp_s") -> DataFrame:
    out = samples.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_samples"), (F.max(at) - F.min(at)).alias("_span"))
    return out.select("task_id", F.when(F.col("n_samples") >= 2, F.bround("_span", 1)).alias("duration_s"), "n_samples")


def counter_rate(samples: DataFrame, counters: dict[str, str], key: str = "task_id", at: str = "timestamp_s", order: str = "event_id", block_s: int = 3600) -> DataFrame:
    """MB/s between consecutive samples of cumulative byte counters.

    A task's samples are cut into blocks of time, so a task with a large share
    of all samples is spread over tasks of the engine. The last sample of the
    block before is handed to the first row of the next one.
    """
    block = (F.col(at) / block_s).cast("bigint")
    cut = samples.withColumn("_block", block)
    names = list(counters.values())
    line = Window.partitionBy(key, "_block").orderBy(at, order)
    packed = F.struct(F.col(at).alias("t"), F.col(order).alias("o"), *[F.col(c).alias(c) for c in names])
    lasts = cut.groupBy(key, "_block").agg(F.max(packed).alias("_last"))
    # one row per task and block of time
    carried = lasts.withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy("_block"))).select(
        F.col(key).alias("_key"), F.col("_block").alias("_kblock"), "_before"
    )
    rows = cut.withColumn("_prev", F.lag(packed).over(line)).join(carried, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_kblock")))
    prev = F.coalesce("_prev", "_before")
    dt = F.col(at) - prev["t"]
    out = [F.col(key), F.col(order), F.col(at)]
    for name, column in counters.items():
        rate = F.bround((F.col(column) - prev[column]) / F.when(dt > 0, dt) / 1048576.0, 2)
        out.append(F.when(prev.isNull() | (dt <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), rate)).alias(name))
    return rows.select(*out)


def celsius(millidegrees: str) -> Column:
    return F.bround(F.col(millidegrees) / 1000.0, 1)


def gibibytes(count: str) -> Column:
    return F.bround(F.col(count) / 1073741824.0, 2)

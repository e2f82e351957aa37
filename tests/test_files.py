"""File sources and sinks on small files."""

import json

from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.operators import configspace
from tidewater.sources import files, quality


def test_delimited(spark, tmp_path):
    (tmp_path / "reason.dat").write_bytes("1|AAAA  |caf\xe9|\n2|BBBB||\n".encode("latin-1"))
    got = files.load_suite(spark, str(tmp_path), schemas.TPCDS, "dat", "ISO-8859-1", True)
    assert list(got) == ["reason"]
    assert [tuple(r) for r in got["reason"].orderBy("r_reason_sk").collect()] == [(1, "AAAA", "caf\xe9"), (2, "BBBB", None)]


def test_schemas():
    assert len(schemas.TPCDS) == 24 and len(schemas.TPCH) == 8
    sizes = {"store_sales": 23, "catalog_sales": 34, "web_sales": 34, "store": 29, "date_dim": 28, "item": 22, "call_center": 31, "web_site": 26, "promotion": 19}
    assert {t: len(schemas.TPCDS[t]) for t in sizes} == sizes
    assert schemas.primary_key("web_site") == ["web_site_sk"]


def test_documents(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (deep / "task_1.json").write_text(json.dumps({"task_id": 1, "tier": "low", "status": "done", "pg_config": {"jit": "on"}, "tpc_h": {"total_ms": 5.0}}, indent=1))
    (deep / "task_2.json").write_text(json.dumps({"task_id": 2, "status": "running"}))
    (deep / "task_3.json").write_text("{broken")
    (deep / "other.json").write_text("{}")
    rows = files.read_documents(spark, str(tmp_path), str(deep)).collect()
    assert [(r.task_id, r.tpc_h.total_ms, r.pg_config) for r in rows] == [(1, 5.0, {"jit": "on"})]
    assert [(r.path.rsplit("/")[-1], r.text) for r in files.rejected_documents(spark, str(tmp_path)).collect()] == [("task_3.json", "{broken")]


def test_space_and_candidates(spark, tmp_path):
    stage = tmp_path / "stage1"
    stage.mkdir()
    (stage / "low.json").write_text(json.dumps({"_meta": {"type": "x"}, "jit": {"type": "categorical", "choices": {"mode": "discrete", "values": [0]}},
                                                "random_page_cost": {"type": "float", "choices": {"mode": "range", "values": {"min": 1.0, "max": 4.0}}}}))
    got = {(r.stage, r.tier, r.param, r.mode, r.min, r.max, r.idx, r.choice) for r in files.read_space(spark, str(tmp_path)).collect()}
    assert got == {(1, "low", "jit", "discrete", None, None, 0, "0"), (1, "low", "random_page_cost", "range", 1.0, 4.0, None, None)}
    (tmp_path / "c.json").write_text(json.dumps([{"jit": "on"}, {"jit": "off", "work_mem": "4MB"}]))
    assert [(r.candidate_idx, r.config) for r in files.read_candidates(spark, str(tmp_path / "c.json")).collect()] == [(0, {"jit": "on"}), (1, {"jit": "off", "work_mem": "4MB"})]
    assert all(r.ok for r in configspace.diagnose(configspace.space_rows(spark)).collect())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "low"), (2, "high")], "task_id long, tier string")
    files.write_features(df, str(tmp_path / "f"))
    assert files.read_features(spark, str(tmp_path / "f")).count() == 2
    for run in ("a", "b", "b"):
        files.append_metrics(df, str(tmp_path / "m"), run)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4


def test_statistics_reach_the_optimizer(spark, tmp_path):
    """The sizes that joins are planned by are those of the rows left, once the catalogue knows the columns."""
    spark.range(50_000).selectExpr("id", "id % 100 as k", "if(id % 10 = 0, null, id) as v").write.parquet(str(tmp_path / "facts"))
    tables = files.declare(spark, {"facts": str(tmp_path / "facts")}, "stats_test")
    try:
        got = {r.column_name: tuple(r)[2:] for r in files.statistics(spark, tables, {"facts": ["id", "k", "v"]}).collect()}
        assert {c: (r[0], r[1], r[3], r[4]) for c, r in got.items()} == {"id": (50_000, 0, 0, 49_999), "k": (50_000, 0, 0, 99), "v": (50_000, 5_000, 1, 49_999)}
        assert abs(got["k"][2] - 100) <= 10
        planned = spark.table(tables[0]).where("k = 7")._jdf.queryExecution().optimizedPlan().stats()
        assert 300 <= int(planned.rowCount().get()) <= 700
    finally:
        files.forget(spark, tables)
    assert (tmp_path / "facts").exists() and "stats_test" not in [r[0] for r in spark.sql("show databases").collect()]


def test_quality(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (2, "y")], "k long, v string")
    assert [tuple(r) for r in quality.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    assert [tuple(r) for r in quality.missing_values(df, ["k", "v"]).collect()] == [("v", 1)]
    assert [r.k for r in quality.orphans(df, ["k"], spark.createDataFrame([(1,)], "p long"), ["p"]).collect()] == [2]


def test_streams_over_a_file_a_folder_and_nothing(spark, tmp_path):
    from tidewater.streaming import live

    rows = spark.range(100).selectExpr("id % 7 as task_id", "'tpc_h' as suite", "id % 3 = 0 as success", "timestamp_seconds(id % 7) as started_at")
    rows.repartition(4).write.parquet(str(tmp_path / "log.parquet"))
    rows.limit(0).write.parquet(str(tmp_path / "none.parquet"))
    found = live.run_to_end(live.running_outcomes(live.file_stream(spark, str(tmp_path), "log")), ["task_id", "suite"])
    assert sum(r.n_success + r.n_failed for r in found.collect()) == 100
    none = live.run_to_end(live.running_outcomes(live.file_stream(spark, str(tmp_path), "none")), ["task_id", "suite"])
    assert none.count() == 0


def _states(query):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


def test_state_ends_and_deadlines_raise_alarms(spark, tmp_path):
    from tidewater.streaming import live

    hour, schema = 3600, "task_id long, suite string, tier string, success boolean, exec_ms double, finished boolean, started_s long, at_s long"
    batches = [
        [(1, "low", False, 0, 0), (2, "low", False, 0, 60), (3, "high", False, 0, 0)],
        [(2, "low", True, 0, hour), (1, "low", False, 0, 2 * hour)],  # 2 finishes in time
        [(4, "low", False, 4 * hour, 4 * hour), (1, "low", True, 0, 4 * hour)],  # 1 ends after its three hours; the watermark passes them
        [(5, "low", False, 40 * hour, 40 * hour)],
        [(8, "low", True, 41 * hour, 41 * hour)],  # rows are held against the watermark of one batch before
        [(6, "low", False, 0, 60)],  # later than the watermark: dropped
        [(7, "low", True, 80 * hour, 80 * hour)],
    ]
    folder = tmp_path / "log.parquet"
    for n, batch in enumerate(batches):
        rows = [(i, "tpc_h", tier, True, 500.0, done, start, at) for i, tier, done, start, at in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        folder.mkdir(exist_ok=True)
        next((tmp_path / f"part{n}").glob("*.parquet")).rename(folder / f"{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    log = stream.withColumns({"started_at": F.timestamp_seconds(F.col("started_s") + 1_700_000_000), "at": F.timestamp_seconds(F.col("at_s") + 1_700_000_000)})

    def run(out, mode, name):
        query = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()], _states(query)

    alarms, states = run(live.overdue(log).selectExpr("task_id", "tier", "unix_seconds(deadline_at) - 1700000000", "n_runs"), "append", "alarms")
    assert sorted(alarms) == [(1, "low", 3 * hour, 3), (3, "high", 8 * hour, 1), (4, "low", 7 * hour, 1), (5, "low", 43 * hour, 1)]
    assert max(states) > 0 and states[-1] == 0
    counts, states = run(live.running_outcomes(log), "update", "counts")
    assert {(r[0], r[1]): r[2] for r in counts if r[0] in (1, 2)} == {(1, "tpc_h"): 3, (2, "tpc_h"): 2} and not [r for r in counts if r[0] == 6]
    assert max(states) >= 3 and states[-1] <= 1


def test_tasks_of_a_busy_group_get_their_alarms():
    import pandas as pd

    from tidewater.streaming import live

    class State:
        exists, hasTimedOut, value, watermark, timer = False, False, None, 0, None
        get = property(lambda self: self.value)
        getCurrentWatermarkMs = lambda self: self.watermark

        def update(self, value):
            self.value, self.exists = value, True

        def remove(self):
            self.value, self.exists = None, False

        def setTimeoutTimestamp(self, at):
            self.timer = at

    state, hour, never = State(), 3_600_000_000, live._NEVER

    def call(rows, watermark_h=0):
        state.watermark, state.hasTimedOut = watermark_h * hour // 1000, rows is None
        frames = [] if rows is None else [pd.DataFrame(rows, columns=["task", "named", "tier", "at_us", "ended_us", "exec_ms"])]
        return [(None if pd.isna(r.task_id) else int(r.task_id), r.tier, r.spent_s, int(r.n_runs)) for f in live._alarm((0,), iter(frames), state) for r in f.itertuples()]

    first = [(2**60 + 1, True, "low", 0, never, 500.0), (2, True, "high", 0, never, 1.0), (3, True, "low", 0, hour, 1.0), (0, False, "medium", 0, never, 2.0), (0, True, "high", 60, never, 1.0)]
    assert call(first) == [] and state.timer == 3 * hour // 1000
    assert call([(2**60 + 1, True, "low", hour, never, 250.0)]) == []
    # another task of the group reports: the alarm comes all the same, that of a task which reports waits a batch
    assert call([(2, True, "high", hour, never, 1.0)], 4) == [(2**60 + 1, "low", 0.75, 2)]
    assert call([(2, True, "high", hour, never, 1.0)], 9) == [(None, "medium", 0.002, 1), (0, "high", 0.001, 1)] and state.timer == 9 * hour // 1000 + 1
    assert call(None, 10) == [(2, "high", 0.003, 3)] and not state.exists

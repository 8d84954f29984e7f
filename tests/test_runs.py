"""Run folders with two writers, stages that later runs find again, lookups of a study."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from strataloom.operators import layers as ly
from strataloom.plans.staged import Stage, StagedTables
from strataloom.plans.study import Study, open_study
from strataloom.plans.sweep import expand_grid
from strataloom.sources.runs import Files, RunStore


def test_of_several_writers_one_wins(spark, tmp_path):
    files = Files(spark, f"{tmp_path}/x")
    for n in range(3):
        with ThreadPoolExecutor(6) as pool:
            won = list(pool.map(lambda k, n=n: files.claim(f"{tmp_path}/run{n}", f"owner{k}"), range(6)))
        assert sum(won) == 1 and files.read(f"{tmp_path}/run{n}/owner") == f"owner{won.index(True)}"
    assert not [x for x in files.names(str(tmp_path)) if x.startswith(".claim")]
    with ThreadPoolExecutor(4) as pool:
        paths = {s.path for s in pool.map(lambda _: RunStore(spark, f"{tmp_path}/study"), range(4))}
    assert paths == {f"{tmp_path}/study{s}" for s in ("", "-002", "-003", "-004")}
    assert RunStore(spark, f"{tmp_path}/study-002", resume=True).path.endswith("-002")
    with pytest.raises(FileNotFoundError):
        RunStore(spark, f"{tmp_path}/none", resume=True)


def test_results_stand_once(spark, tmp_path):
    store = RunStore(spark, f"{tmp_path}/run")
    store.write_manifest(axes={"a": [1, 2]})
    assert store.manifest()["axes"] == {"a": [1, 2]} and store.manifest()["format"] == 1
    assert store.results().count() == 0
    store.record_configs({"h1": {"a": 1}, "h2": {"a": 2}})
    first = spark.createDataFrame([("h1", "ok", None, 3), ("h2", "error", "no", None)], "hash string, status string, error string, b0 int")
    for _ in range(2):  # a batch that is written again
        store.record(first, "first")
    assert store.results().count() == 2 and [r["hash"] for r in store.completed().collect()] == ["h1"]
    store.record(spark.createDataFrame([("h2", "ok", 5)], "hash string, status string, b0 int"), "second")
    spark.range(3).write.parquet(f"{store.path}/results/torn")
    store.files.delete(f"{store.path}/results/torn/_SUCCESS")  # a batch that never finished
    got = sorted(map(tuple, store.rows("b0 int", "a int").collect()))
    assert got == [("h1", "ok", None, 1, 3), ("h2", "ok", None, 2, 5)]
    store.save_artifact("h1", spark.range(4))
    assert store.artifact("h1").count() == 4
    with pytest.raises(FileNotFoundError):
        store.artifact("h2")


def _stages(calls):
    def cloud(before, layer):
        calls.append(("cloud", layer))
        return calls.spark.range(10 * layer).select(F.col("id"), (F.col("id") % 3).alias("k"))

    def lens(before, layer, lens):
        calls.append(("lens", layer, lens))
        return before.withColumn("v", F.col("k") * len(lens))

    def cover(before, layer, lens, n):
        calls.append(("cover", layer, lens, n))
        return before.groupBy((F.col("v") % n).alias("cell")).agg(F.count(F.lit(1)).alias("c"))

    return [Stage("cloud", ("layer",), cloud), Stage("lens", ("layer", "lens"), lens), Stage("cover", ("layer", "lens", "n"), cover)]


class _Calls(list):
    spark = None


def test_a_second_run_makes_only_what_is_new(spark, tmp_path):
    calls, order = _Calls(), ["layer", "lens", "n"]
    calls.spark = spark
    axes = {"layer": [1, 2], "lens": ["l2", "pca"], "n": [2, 3]}
    one = StagedTables(spark, f"{tmp_path}/cache", _stages(calls), order)
    first = {tuple(c.values()): sorted(map(tuple, t.collect())) for c, t in one.tables(expand_grid(axes))}
    assert one.made == {"cloud": 2, "lens": 4, "cover": 8} and len(calls) == 14
    calls.clear()
    two = StagedTables(spark, f"{tmp_path}/cache", _stages(calls), order)
    more = axes | {"n": [2, 3, 4]}
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("second", "second run")
    again = {tuple(c.values()): sorted(map(tuple, t.collect())) for c, t in two.tables(expand_grid(more))}
    assert len(jobs.getJobIdsForGroup("second")) > 0
    assert two.made == {"cloud": 0, "lens": 0, "cover": 4} and {x[0] for x in calls} == {"cover"} and {x[3] for x in calls} == {4}
    assert {k: v for k, v in again.items() if k in first} == first
    calls.clear()
    wide = StagedTables(spark, f"{tmp_path}/cache", _stages(calls), order)
    list(wide.tables(expand_grid(axes | {"lens": ["l2", "density"]})))
    assert wide.made == {"cloud": 0, "lens": 2, "cover": 4}
    assert wide.drop_unneeded(expand_grid(axes | {"layer": [1], "lens": ["l2"]})) == (2 - 1) + (6 - 1) + (12 + 4 - 2)
    other = StagedTables(spark, f"{tmp_path}/cache", _stages(calls), order, version="2")
    other.table({"layer": 1, "lens": "l2", "n": 2})
    assert other.made == {"cloud": 1, "lens": 1, "cover": 1}


def test_tables_go_when_no_setting_needs_them(spark, tmp_path):
    calls = _Calls()
    calls.spark = spark
    t = StagedTables(spark, f"{tmp_path}/cache", _stages(calls), ["layer", "lens", "n"])
    left = []
    for _, table in t.tables(expand_grid({"layer": [1, 2], "lens": ["l2"], "n": [2, 3]}), keep=False):
        assert table.count()
        left.append([len(t.files.names(f"{tmp_path}/cache/{s}")) for s in ("cloud", "lens", "cover")])
    assert left == [[1, 1, 1]] * 4 and not t.files.names(f"{tmp_path}/cache/cover")
    assert t.made == {"cloud": 2, "lens": 2, "cover": 4}


def test_stages_are_checked(spark, tmp_path):
    f = lambda before, **axes: before
    for stages, why in (([Stage("a", ("z",), f)], "unknown axes"), ([Stage("a", ("y",), f)], "first axes"), ([Stage("a", ("x", "y"), f), Stage("b", ("x",), f)], "fewer axes"), ([Stage("a", ("x",), f)] * 2, "two stages")):
        with pytest.raises(ValueError, match=why):
            StagedTables(spark, str(tmp_path), stages, ["x", "y"])


def test_study_knows_where_its_rows_come_from(spark, tmp_path):
    members = spark.createDataFrame([(f"m{k}", k, k / 10) for k in range(6)], "member_id string, seed long, accuracy double")
    weights = spark.createDataFrame([(f"m{k}", layer, i, j, ((k * 7 + i * 3 + j * 5 + layer) % 11) / 10) for k in range(6) for layer in (0, 1) for i in range(8) for j in range(3)], "member_id string, layer_idx int, i long, j long, w double")
    store = RunStore(spark, f"{tmp_path}/study")
    study = Study(store, members, weights)
    axes = {"lens": "coord0", "n_intervals": [2, 3], "overlap": 0.3, "clusterer": "single", "cut": 0.5}
    study.run(["0/rows"], axes, "a")
    rows = study.rows().collect()
    assert len(rows) == 2 and {r.cloud for r in rows} == {"0/rows"} and {r.n_intervals for r in rows} == {2, 3}
    study = open_study(spark, store.path, members, weights)
    study.run(["0/rows", "1/rows"], axes, "b")  # the first two are done
    assert study.rows().count() == 4
    row = next(r for r in study.rows().collect() if r.cloud == "1/rows" and r.n_intervals == 3)
    nodes, edges = study.graph(row.hash)
    live = nodes.filter("label >= 0")
    assert live.select("cell", "label").distinct().count() == row.n_nodes and edges.count() == row.n_edges
    cloud = study.cloud_of(row.hash)
    assert cloud.count() == 6 * 8 and cloud.select("id").distinct().count() == 48
    want = {(r.member_id, r.n): tuple(r.x) for r in ly.population_cloud(weights.filter("layer_idx = 1"), "rows").collect()}
    labels = {r.id: r for r in study.labels_of(row.hash).collect()}
    assert all(tuple(r.x) == want[labels[r.id].member_id, labels[r.id].n] and labels[r.id].accuracy == labels[r.id].seed / 10 for r in cloud.collect())
    behind = study.members_of(row.hash).collect()
    assert sum(r.n_points for r in behind) == live.count() and all(r.n_members == len(r.member_ids) and 0 <= r.mean_accuracy <= 0.5 for r in behind)
    assert study.leading("b1", median=0).count() == 4 and study.store.manifest()["clouds"] == ["0/rows", "1/rows"]
    with pytest.raises(FileNotFoundError):
        study.graph("nothing")
    with pytest.raises(KeyError):
        study.config("nothing")

"""Work that has to grow no faster than the rows: how often tables are read, in how many parts, and what is sent."""

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tarnwatch import session
from tarnwatch.operators import bootstrap as bs
from tarnwatch.operators import reconcile as rc
from tarnwatch.operators import training as tr
from tarnwatch.streaming import labels as sl
from tarnwatch.streaming import telemetry as stt
from tarnwatch.workload import drifts, metrics, stores
from tarnwatch.workload.base import table

SF = "/root/testdata/sf0.001"


def test_cells_are_packed_before_they_are_dealt_to_blocks(spark):
    cells = spark.range(400).select(
        F.lit("a").alias("g"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("candidate"),
        (F.col("id") / 20).cast("int").alias("champion"), F.lit(3).cast("long").alias("n"),
        *[F.lit(0.3).alias(f"{m}_{part}") for m in bs.MODELS for part in ("sum", "error")])
    drawn = bs.bootstrap_replicates(cells, [k / 20 for k in range(1, 20)], (0.5, 0.5), 450, 7, 10, ["g"])
    assert drawn.count() == 450 and drawn.select("replicate").distinct().count() == 450
    assert "collect_list" in drawn._jdf.queryExecution().optimizedPlan().toString()


def test_state_of_streams_is_not_kept_on_the_heap(spark, tmp_path):
    source, home = str(tmp_path / "source"), str(tmp_path / "checkpoint")
    events = spark.range(20).select((F.col("id") % 5).alias("k"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    events.write.parquet(source)
    before = dict(spark.conf.getAll)
    stt.run_available(sl.without_redeliveries(spark.readStream.schema(events.schema).parquet(source), ["k"], "at"), str(tmp_path / "out"), home)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert "RocksDBStateStoreProvider" in "".join(r[0] for r in spark.read.text(f"{home}/offsets/0").collect())
    assert dict(spark.conf.getAll) == before


def test_models_of_the_same_rows_share_a_split(spark, monkeypatch):
    seen = []
    split = tr.stratified_split
    monkeypatch.setattr(tr, "stratified_split", lambda *a, **k: seen.append(1) or split(*a, **k))
    assert metrics.candidate_evaluation(spark, SF).count() == 1
    assert len(seen) == 2       # once for both models, once rebuilt from keys and seed for the gates


def test_linear_fits_read_bounded_files_and_shuffle_nothing(spark, monkeypatch):
    seen, linear, before = [], tr.logistic, dict(spark.conf.getAll)
    def kept(*a, **k):
        estimator = linear(*a, **k)
        def fit(rows):
            sizes = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
            seen.append((rows._jdf.queryExecution().executedPlan().toString(), *sizes, rows.columns))
            return estimator.fit(rows)
        return SimpleNamespace(fit=fit)
    monkeypatch.setattr(tr, "logistic", kept)
    monkeypatch.setattr(tr, "FIT_ROWS", 200)
    assert metrics.candidate_evaluation(spark, SF).count() == 1
    assert len(seen) == 2 and dict(spark.conf.getAll) == before
    for plan, most, rows, columns in seen:
        assert "Exchange" not in plan and most <= 200 and rows > 4000 and "line_id" not in columns


def test_shuffles_of_the_model_table_go_when_it_is_written(spark, monkeypatch):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    def files():
        found = manager.getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {x for x in names if x.startswith("shuffle_")}
    class Seen(Exception):
        pass
    def stop(*a, **k):
        raise Seen
    monkeypatch.setattr(tr, "training_parts", stop)
    before = files()
    with pytest.raises(Seen):
        metrics.candidate_evaluation(spark, SF)
    until = time.time() + 10
    while files() - before and time.time() < until:     # they are removed in the background
        time.sleep(0.1)
    assert not files() - before


def test_lines_meet_by_part_only_unless_their_ids_may_name_another(spark, tmp_path, monkeypatch):
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double"
    whole = [(o, 1, o % 3, s, 5.5, 7.0, 0.1) for o in range(40) for s in (1, 2)]
    holed = [(1, 2, 3, None, 9.0, 1.0, 0.1), (1, None, 2, 3, 9.0, 1.0, 0.1), (None, 1, 2, 3, 9.0, 1.0, 0.1), (1, 2, 3, 9, None, 1.0, 0.1),
             (5, 1, None, 2, 5.5, 1.0, 0.1), (5, 1, 2, None, None, None, None), (-1, 1, 2, -3, -0.0, 1.0, 0.1), (-1, 1, 2, -3, 0.0, 1.0, 0.1)]
    spark.createDataFrame([*whole, *whole, *holed, *holed], line).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(0, 10, 900.0), (1, 20, 901.0), (1, 20, 901.0), (2, 30, 902.0), (3, 40, 903.0), (None, 50, 904.0), (7, 60, 905.0)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    class Seen(Exception):
        pass
    def stop(df, *a, **k):
        raise Seen(df)
    monkeypatch.setattr(metrics, "freeze", stop)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with pytest.raises(Seen) as seen:
            metrics.candidate_evaluation(spark, str(tmp_path))
        found = seen.value.args[0]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(l_partkey") == 4 and plan.count("Exchange") == 5
        rows, every = [tuple(r) for r in found.collect()], {tuple(r) for r in metrics.model_table(spark, str(tmp_path)).collect()}
        assert len(rows) == len({r[0] for r in rows}) == 80 + 5 and {r[0] for r in rows} == {r[0] for r in every} and set(rows) <= every
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_joins_start_with_many_parts(spark):
    before = dict(spark.conf.getAll)
    assert set(session.large_join(spark).values()) >= {str(session.FIRST_PARTS)}
    with session.settings(spark, {"spark.sql.shuffle.partitions": "4000"}):
        assert set(session.large_join(spark).values()) >= {"4000"}      # a cluster's own number is not made smaller
    assert dict(spark.conf.getAll) == before


def test_copies_are_sorted_in_parts_of_bounded_size(spark):
    rows = spark.range(50).select((F.col("id") % 7).alias("k"), F.lit("x").alias("v"))
    found = rc.collapsed(rows, ["k"])
    assert found.agg(F.sum("copies"), F.count_if("conflict")).first()[:] == (50, 0) and found.count() == 7
    assert "RebalancePartitions [k#" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2      # collapsed before ids meet


def test_rows_of_a_fit_are_dealt_in_as_many_parts_as_they_need(spark, monkeypatch):
    seen = []
    trees = tr.boosted_trees
    def kept(*a, **k):
        estimator = trees(*a, **k)
        return SimpleNamespace(fit=lambda rows: seen.append((rows.rdd.getNumPartitions(), rows.count())) or estimator.fit(rows))
    monkeypatch.setattr(tr, "boosted_trees", kept)
    monkeypatch.setattr(tr, "FIT_ROWS", 200, raising=False)
    split = metrics.boosted_trees_training_run(spark, SF).first()["split_rows"]
    [(parts, rows)] = seen
    assert rows == split["train"] and parts == -(-rows // 200) > 8


def test_windows_are_not_cut_from_all_lines_again_and_again(spark, monkeypatch):
    seen = []
    def run(folder, windows, profile, **given):
        seen.append(windows.inputFiles())
        return SimpleNamespace(data=windows, reused=True)
    monkeypatch.setattr(drifts.mo, "monitoring_run", run)
    drifts.monitoring_run(spark, SF)
    assert len(seen) == 2 and not any("lineitem" in file for files in seen for file in files)


def test_rows_are_dealt_in_as_many_parts_as_they_need(spark, monkeypatch):
    plans = []
    load = stores.manifest.load_verified
    def kept(df, *a, **k):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return load(df, *a, **k)
    monkeypatch.setattr(stores.manifest, "load_verified", kept)
    assert stores.dataset_manifest_counts(spark, SF).first()["row_count"] == table(spark, SF, "lineitem").count()
    assert "RebalancePartitions" in plans[0] and "RepartitionByExpression" not in plans[0]     # no fixed number of parts

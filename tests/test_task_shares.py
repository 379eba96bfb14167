"""No task of the queries on injected rows reads most of them, however few the groups they join by."""

import pathlib

import pytest

import __spark_entry__ as entry_points

SF = pathlib.Path("/root/testdata/sf0.01")
QUERIES = entry_points.queries()
NAMES = [
    "detection_rate_by_type",
    "best_threshold_by_g_mean",
    "comparison_means",
    "detector_overlap",
    "family_dominance",
    "forest_threshold_sweep",
    "greedy_order_by_catches",
    "metrics_by_history_bucket",
    "nearest_to_default",
    "optimal_threshold_by_level",
    "ranking_agreement",
    "recall_stability",
    "scope_weighted_means",
    "split_summary",
    "subsampling_adequacy",
    "threshold_sweep",
    "threshold_trends",
    "tuning_sweep_round_trip",
]
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def as_on_large_tables(spark):
    """Joins that Spark would not broadcast by itself and partitions that are not merged."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def most_read(spark, group):
    """Shuffled rows read by the largest task of a job group."""
    store, tracker, most = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker(), 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 10000)
            for i in range(tasks.size()):
                metrics = tasks.apply(i).taskMetrics()
                if metrics.isDefined():
                    most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return most


def test_no_task_reads_most_rows(spark, as_on_large_tables, tmp_path):
    # A new folder, so that injection, scores, candidates and forests are built within the group.
    for source in SF.glob("*.parquet"):
        (tmp_path / source.name).symlink_to(source)
    rows, most = spark.read.parquet(str(tmp_path / "lineitem.parquet")).count(), {}
    try:
        for name in NAMES:
            spark.sparkContext.setJobGroup(f"share-{name}", name)
            assert QUERIES[name](spark, str(tmp_path)).collect()
            most[name] = most_read(spark, f"share-{name}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(most.values()) < 0.5 * rows, most

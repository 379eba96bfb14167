"""Disk that the shared tables and their shuffles take, and what percentiles shuffle."""

import time

from pyspark.sql import functions as F

from tidemark.catalog import models
from tidemark.plans.skew import exact_percentiles
from tidemark.session import shared_root


def table_bytes(spark):
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(fs_path).getLength()


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_forest_tables_and_their_shuffles_stay_small(spark, tmp_path):
    """Bytes a row of all that the country forest stores: on sf0.1 335 with whole rows and histories, 140 without."""
    d = tmp_path / "data"
    d.symlink_to("/root/testdata/sf0.01")
    tables, shuffled = table_bytes(spark), shuffle_bytes(spark)
    rows = models.country_forest(spark, str(d)).count()
    assert rows == 60_000 and (table_bytes(spark) - tables) / rows < 200
    until = time.time() + 20
    while shuffle_bytes(spark) - shuffled > 500_000 and time.time() < until:
        time.sleep(0.5)
    assert shuffle_bytes(spark) - shuffled <= 500_000


def test_percentiles_shuffle_only_wanted_slices(spark):
    """400,000 distinct values, of which the slices around the median are shuffled: under 1 MB, 1.5 MB before."""
    rows = spark.range(400_000).select((F.hash("id") + F.col("id") * 0.37).alias("v"))
    out = exact_percentiles(rows, [], "v", {"m": 0.5}, slice_rows=1_000)
    before = shuffle_bytes(spark)
    found = out.first()["m"]
    assert shuffle_bytes(spark) - before < 1_000_000
    assert found == rows.agg(F.percentile("v", F.lit(0.5))).first()[0]

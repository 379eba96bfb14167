"""Mean and deviation to the last bit: z-scores that meet a threshold exactly are decided by it."""

import random

import duckdb

from tidemark.functions import scales
from tidemark.operators.rules import Baseline


def test_moments_equal_the_sql_aggregates_bit_by_bit(spark):
    rng = random.Random(7)
    lists = [[rng.randint(90000, 110000) / 100 * (1 - rng.randint(0, 10) / 100) for _ in range(n)]
             for n in range(2, 31) for _ in range(10)] + [[5.1] * 7, [3.3]]
    # 2.9 deviations exactly: the discounts of one list price.
    lists += [[p * (1 - k / 100) for k in (0, 4, 9, 2)] for p in (898.05, 926.11, 1000.01, 1417.41)]
    df = spark.createDataFrame(list(enumerate(lists)), "i INT, h ARRAY<DOUBLE>")
    got = {r.i: (r.m, r.s) for r in df.select("i", scales.array_mean("h").alias("m"), scales.array_std(df.h).alias("s")).collect()}
    sql = "SELECT list_avg(h), coalesce(list_stddev_samp(h), 0) FROM (SELECT ?::DOUBLE[] AS h)"
    for i, h in enumerate(lists):
        want = duckdb.execute(sql, [h]).fetchall()[0]
        assert got[i] == want
        mean, std = Baseline(h).mean_std()
        assert std == want[1] and (mean == want[0] or std == 0.0)

"""Prices that lie exactly 2.9 deviations from their history: each query decides them as its SQL does."""

import datetime
import itertools
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from check_oracles import rows_of

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
NAMES = [
    "binary_metrics_by_country",
    "cascade_default_without_model",
    "cascade_minimal",
    "cascade_statistical_only",
    "combined_case_metrics",
    "detect_ensemble",
    "detect_zscore",
    "detector_metrics",
    "gated_cascade_minimal",
    "gated_zscore",
    "joined_truth_metrics",
    "layer_history_bounds",
    "one_vs_rest_type_metrics",
    "pooled_dataset_metrics",
]
# Discounts of four prices in any order and of the price 2.9 deviations away.
TIES = [((0, 2, 3, 6), 10), ((4, 7, 8, 10), 0)]


@pytest.fixture(scope="module")
def ties(tmp_path_factory):
    """A folder of tables with 960 series of five prices, the last one at the threshold."""
    root = tmp_path_factory.mktemp("ties")
    rng = random.Random(29)
    part, line = [], []
    for past, last in TIES:
        for order in itertools.permutations(past):
            for _ in range(20):
                key = len(part)
                part.append((key, f"part {key}", "brand", "type", 1, rng.randint(90000, 110000) / 100))
                for i, discount in enumerate((*order, last)):
                    line.append((key * 10 + i, key, 0, i % 3 + 1, 1.0, 1.0, discount / 100, 0.0, "N", "F",
                                 datetime.datetime(1999, 1 + i, 1 + key % 28)))
    tables = {
        "region": ([(0, "r")], "r_regionkey INTEGER, r_name VARCHAR"),
        "nation": ([(0, "n", 0)], "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER"),
        "supplier": ([(0, "s", 0, 1.0)], "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE"),
        "part": (part, "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE"),
        "lineitem": (line, "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, "
                           "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP"),
    }
    con = duckdb.connect()
    for name, (rows, columns) in tables.items():
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])  # noqa: F841 - read by DuckDB
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.execute(f"INSERT INTO {name} SELECT * FROM frame")
        con.execute(f"COPY {name} TO '{root}/{name}.parquet' (FORMAT parquet)")
    return str(root), con


@pytest.mark.parametrize("name", NAMES)
def test_ties_fall_as_in_the_sql(spark, ties, name):
    root, con = ties
    got = rows_of(QUERIES[name](spark, root).toPandas())
    want = rows_of(con.execute(ORACLES[name]).df())
    assert got[0] == want[0]
    different = [pair for pair in zip(got[1], want[1]) if pair[0] != pair[1]]
    assert len(got[1]) == len(want[1]) and not different, (len(different), different[:2])

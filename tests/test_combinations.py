"""Flags of the named combinations on hand-made detector results."""

from tidemark.operators import cascade as C

RESULT = "struct<flagged: boolean, score: double, severity: string, types: array<string>, insufficient: boolean>"


def test_named_combinations(spark):
    def result(flagged, score, insufficient=False):
        return (flagged, score, None, ["t"] if flagged else [], insufficient)

    quiet, loud = result(False, 0.1), result(True, 0.9)
    rows = [
        (0, 20, loud, quiet, quiet), (1, 20, quiet, loud, quiet), (2, 20, quiet, result(True, 0.95), result(False, 0.2)),
        (3, 20, loud, loud, loud), (4, 2, quiet, result(False, 0.0, True), result(True, 0.6)), (5, 7, quiet, loud, quiet),
    ]
    df = spark.createDataFrame(rows, f"id INT, observation_count LONG, sanity {RESULT}, zscore {RESULT}, iforest {RESULT}")

    def flagged(name):
        flag = C.combination_flag(C.COMBINATIONS[name], ["sanity", "zscore", "iforest"])
        return [r.id for r in df.filter(flag).orderBy("id").collect()]

    assert flagged("IF + Z 50/50") == [1, 2, 3, 4, 5]
    # Where the gate fires nothing is left to average.
    assert flagged("Sanity -> IF + Z") == [1, 2, 4, 5]
    assert flagged("Sanity -> Z") == [0, 1, 2, 3, 5]
    assert flagged("Sanity -> Z(>=5) -> IF") == [0, 1, 2, 3, 4, 5]
    assert flagged("Sanity -> Z(>=10) -> IF") == [0, 1, 2, 3, 4]

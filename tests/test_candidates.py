"""Many rules in one pass: as many single folds, and the refitted sweep over all families."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import candidates as C
from tidemark.operators import fold as G
from tidemark.operators import rules as R
from tidemark.operators import sweeps as W

T0 = dt.datetime(2024, 1, 1)
ORDER = ["seen_at", "obs_id"]


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = np.random.default_rng(21), []
    for key, n in ((1, 90), (2, 40), (None, 25), (4, 2)):
        for i in range(n):
            odd = rng.random() < 0.12
            price = None if i % 19 == 4 else float(rng.choice([100.0, 101.0, 103.0]) * (rng.choice([0.3, 2.5]) if odd else 1.0))
            out.append((f"{key}-{i:03d}", key, price, T0 + dt.timedelta(hours=int(i * 9)), "AB"[i % 2], ["new_prices", "new_products"][i % 3 == 0], bool(odd)))
    return spark.createDataFrame(out, "obs_id STRING, product_id LONG, price DOUBLE, seen_at TIMESTAMP, attempt STRING, dataset_split STRING, truth BOOLEAN").repartition(3).cache()


RULES = {"z1": R.zscore_rule(1.0), "z2": R.zscore_rule(2.0), "mad": R.modified_rule("mad", 3.0), "iqr": R.iqr_rule(), "change": R.change_rule()}


def failing():
    def rule(price, base, row):
        if len(base.prices) > 5:
            raise ValueError("no more")
        return R.NONE

    return rule


@pytest.mark.parametrize("acceptance", [False, True])
def test_one_pass_equals_single_folds(spark, rows, acceptance):
    states = G.baseline_states(rows.filter("obs_id < '1-020'"), ["product_id"], ORDER)
    many = C.fold_many(rows, ["product_id"], ORDER, RULES, keep=["obs_id"], states=states, acceptance=acceptance)
    got = {(r.detector, r.obs_id): tuple(r)[2:] for r in many.collect()}
    assert len(got) == len(RULES) * rows.count()
    for name, rule in RULES.items():
        single = G.gated_fold(rows, ["product_id"], ORDER, rule, keep=["obs_id"], states=states, acceptance=acceptance)
        assert {r.obs_id: tuple(r)[1:] for r in single.collect()} == {k[1]: v for k, v in got.items() if k[0] == name}
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning(_series") == 1


def test_counts_and_errors(spark, rows):
    got = {(r.dataset_split, r.candidate_id): r for r in C.count_many(rows, ["product_id"], ORDER, {**RULES, "bad": failing()}, ["dataset_split"]).collect()}
    for name, rule in RULES.items():
        folded = G.gated_fold(rows, ["product_id"], ORDER, rule, keep=["dataset_split", "truth"]).collect()
        for split in ("new_prices", "new_products"):
            own = [(r.flagged, r.truth) for r in folded if r.dataset_split == split]
            r = got[split, name]
            assert (r.tp, r.fp, r.fn, r.tn) == tuple(own.count(k) for k in ((True, True), (True, False), (False, True), (False, False)))
            assert r.status == "ok"
    assert {(r.status, r.message, r.tp) for k, r in got.items() if k[1] == "bad"} == {("error", "ValueError: no more", None)}


def test_measured_rules_count_without_a_call_each(spark, rows):
    """All families' grids from one look a kind: the counts of the rules called one by one."""
    grid = {W.candidate_id(f, p): W.rule_of(f, p) for f in W.FAMILIES for p in W.coarse_grid(f)}
    states = G.baseline_states(rows.filter("obs_id < '1-020'"), ["product_id"], ORDER)

    def uncalled(rule):
        def called(price, base, row):
            raise AssertionError("called")

        return R.measured(called, rule.kind, rule.cut, rule.reach)

    def unmeasured(rule):
        return lambda price, base, row: rule(price, base, row)

    quick, plain = ({tuple(r) for r in C.count_many(rows, ["product_id"], ORDER, {i: wrap(r) for i, r in grid.items()},
                                                    ["dataset_split"], states=states).collect()} for wrap in (uncalled, unmeasured))
    assert quick == plain and len(quick) == 2 * len(grid)


def test_a_kind_that_fails_is_reported_alone(spark, rows):
    def broken(price, base, cuts, lo, hi):
        raise ValueError("no reach")

    bad = {f"bad{c}": R.measured(lambda price, base, row: R.NONE, ("bad",), c, broken) for c in (1.0, 2.0)}
    got = {r.candidate_id: r for r in C.count_many(rows, ["product_id"], ORDER, {**RULES, **bad}, []).collect()}
    assert {(got[k].status, got[k].message, got[k].tp) for k in bad} == {("error", "ValueError: no reach", None)}
    assert all(got[k].status == "ok" and got[k].tp + got[k].fp + got[k].fn + got[k].tn == rows.count() for k in RULES)


def test_refitted_sweep_covers_families(spark, rows, monkeypatch):
    real = W.rule_of
    monkeypatch.setattr(W, "rule_of", lambda f, p: failing() if f == "iqr" and p["multiplier"] == 2.0 else real(f, p))
    got = W.refitted_sweep(rows, ["product_id"], ORDER, [], first_attempt="A").collect()
    assert {r.family for r in got} == set(W.FAMILIES) and {r.family for r in got if r.best} == set(W.FAMILIES)
    assert len({r.candidate_id for r in got}) == len(got) and sum(r.best for r in got) == len(W.FAMILIES)
    assert all(r.status == ("error" if r.candidate_id == "iqr__multiplier_2p000" else "ok") for r in got)
    for r in got:
        if r.best and r.family == "hybrid_weighted":
            assert r.params.count("=") == 2
        if r.best:
            assert r.rank_score == max(x.rank_score for x in got if x.family == r.family and x.stage != "screen" and x.status == "ok")

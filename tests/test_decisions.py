"""Decisions on grids: ties, floors, missing cells."""

import pytest

from corploom.operators import decisions

RATES, SEEDS = (1e-5, 2e-5, 5e-5), range(5)
SCHEMA = "rate double, seed int, status string, target double, retention double, nll double, change double"


def frames(spark, values, status=None, base=(0.5, 0.6)):
    """values: of a rate its target, retention, loss and change, the same for all seeds."""
    cells = [(r, s, (status or {}).get((r, s), "complete"), *map(float, v)) for r, v in values.items() for s in SEEDS]
    return spark.createDataFrame(cells, SCHEMA), spark.createDataFrame([base], "base_target double, base_retention double"), spark.createDataFrame([(r, s) for r in RATES for s in SEEDS], "rate double, seed int")


def one(spark, values, **k):
    return decisions.stage_one(*frames(spark, values, **k), 0.01, 0.002, 3, 0.02).collect()[0].asDict()


def other(spark, values, **k):
    return decisions.calibrated_rate(*frames(spark, values, **k), 0.01).collect()[0].asDict()


def test_a_tie_goes_to_the_larger_rate(spark):
    got = one(spark, {1e-5: (0.552, 0.6, 1, 0.1), 2e-5: (0.5505, 0.6, 1, 0.1), 5e-5: (0.549, 0.6, 1, 0.1)})
    assert got["selected"] == 2e-5 and got["passed"] and got["complete"]


def test_a_rate_that_forgets_is_not_eligible(spark):
    got = one(spark, {1e-5: (0.51, 0.6, 1, 0.1), 2e-5: (0.52, 0.595, 1, 0.1), 5e-5: (0.9, 0.58, 1, 0.1)})
    assert got["selected"] == 2e-5 and got["passed"]
    got = one(spark, {r: (0.9, 0.1, 1, 0.1) for r in RATES})
    assert (got["selected"], got["retains"], got["passed"]) == (None, False, False)


@pytest.mark.parametrize(("value", "check"), [((0.49, 0.6, 1, 0.1), "at_or_above_base"), ((0.51, 0.6, 1, 0.01), "moves")])
def test_each_check_shuts_the_gate(spark, value, check):
    got = one(spark, {r: value for r in RATES})
    assert got["selected"] == 5e-5 and not got[check] and not got["passed"] and got["retains"]


def test_an_incomplete_grid_decides_nothing(spark):
    values = {r: (0.9, 0.9, 1, 0.9) for r in RATES}
    for status in ({(2e-5, 3): "failed"}, {(1e-5, s): "running" for s in SEEDS}):
        got = one(spark, values, status=status)
        assert (got["complete"], got["n_missing"], got["selected"], got["passed"], got["retains"]) == (False, len(status), None, False, None)
        assert other(spark, values, status=status) == {"complete": False, "selected": None, "reason": None, "holds_base": None}
    del values[5e-5]
    assert one(spark, values)["n_missing"] == 5 and not one(spark, values)["passed"]


def test_the_other_rule_takes_the_smaller_rate(spark):
    tied = {r: (0.55, 0.6, 1.0, 0.1) for r in RATES}
    assert other(spark, tied) == {"complete": True, "selected": 1e-5, "reason": "floor", "holds_base": True}
    assert other(spark, tied | {2e-5: (0.55, 0.6, 0.9, 0.1)})["selected"] == 2e-5
    assert other(spark, tied | {5e-5: (0.56, 0.6, 9.0, 0.1)})["selected"] == 5e-5
    assert other(spark, tied | {5e-5: (0.99, 0.5, 0.1, 0.1)})["selected"] == 1e-5


def test_the_other_rule_falls_back_on_the_sum(spark):
    low = {1e-5: (0.45, 0.50, 1, 0.1), 2e-5: (0.40, 0.55, 0.1, 0.1), 5e-5: (0.50, 0.30, 1, 0.1)}
    assert other(spark, low) == {"complete": True, "selected": 1e-5, "reason": "fallback", "holds_base": False}
    assert other(spark, low | {5e-5: (0.5, 0.46, 1, 0.1)})["selected"] == 5e-5

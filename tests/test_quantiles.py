"""Radix selection equals numpy: ties, signs, extreme ranges, null groups."""

import math
import random

import numpy as np
import pytest

from quarry.operators.quantiles import exact_quantiles, summary

PROBS = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)


def expected(xs):
    return [float(np.quantile(np.array(xs, dtype=float), p)) for p in PROBS]


@pytest.mark.parametrize("make", [
    lambda r: r.gauss(0, 1), lambda r: r.choice([1.5, 1.5, -2.0, r.random()]), lambda r: float(r.randint(-3, 3)),
    lambda r: math.ldexp(r.random() - 0.5, r.randint(-1000, 1000)), lambda r: 1e15 + r.randint(0, 9) * 0.125,
    lambda r: 1.0 + r.randint(0, 5) * 2.0 ** -52])
def test_equals_numpy(spark, make):
    r = random.Random(3)
    rows = [(g, make(r)) for g in ("a", "b", None) for _ in range(r.randint(1, 400))] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {row.g: list(row)[1:] for row in exact_quantiles(df, "v", PROBS, ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, out in got.items():
        assert out == pytest.approx(expected([v for k, v in rows if k == g and v is not None]), rel=1e-15, abs=0)


def test_no_group_and_no_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (2.0,), (9.0,), (None,)], "v double")
    assert exact_quantiles(df, "v", (0.5, 0.9)).first() == (2.0, pytest.approx(6.9))
    none = exact_quantiles(df.where("v > 100"), "v", (0.5,))
    assert [tuple(r) for r in none.collect()] == [(None,)]
    s = summary(df, "v").first()
    assert (s["min"], s["max"], s["mean"], s["q0500"]) == (2.0, 9.0, 3.75, 2.0)


def test_not_finite(spark):
    df = spark.createDataFrame([(float("-inf"),), (0.0,), (-0.0,), (1e-320,), (float("inf"),), (float("nan"),)], "v double")
    out = exact_quantiles(df, "v", (0.0, 0.2, 0.6, 0.8, 1.0)).first()
    assert out[0] == float("-inf") and out[1] == 0.0 and out[2] == 1e-320 and out[3] == float("inf") and math.isnan(out[4])

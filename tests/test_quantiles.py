import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewatt.operators.explore import iqr_bounds, iqr_outliers
from tidewatt.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.99, 1.0]


def frame(spark, values, name="a"):
    return spark.createDataFrame([(name, float(v)) for v in values], "series_id string, load double")


def check(spark, values, accuracy):
    df = frame(spark, values)
    got = exact_quantiles(df, "load", PROBS, ["series_id"], accuracy=accuracy).first()
    want = np.quantile(np.array(values, dtype=float), PROBS)
    assert np.allclose([got[c] for c in ("q0", "q25", "q50", "q99", "q100")], want, rtol=1e-12, atol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_small_groups_with_ties(spark, values):
    check(spark, values, 100_000)


@pytest.mark.parametrize("accuracy", [50, 1000, 100_000])
def test_coarse_sketches_still_give_exact_results(spark, accuracy):
    check(spark, np.random.default_rng(3).lognormal(0, 3, 20_000), accuracy)
    check(spark, np.repeat([1.0, 2.0, 5.0], [15_000, 10, 300]), accuracy)


def test_no_groups_nulls_and_nans(spark):
    df = spark.sql("SELECT * FROM VALUES (1D), (NULL), (double('nan')), (3D) AS t(v)")
    assert exact_quantiles(df, "v", [0.5]).first()["q50"] == 2.0


def test_iqr(spark):
    df = frame(spark, range(10)).unionByName(frame(spark, [*range(10), 500, -400], "b"))
    bounds = iqr_bounds(df)
    a = bounds.where("series_id = 'a'").first()
    assert (a["q1"], a["q3"], a["lower"], a["upper"]) == (2.25, 6.75, -4.5, 13.5)
    assert sorted(r["load"] for r in iqr_outliers(df, bounds).collect()) == [-400.0, 500.0]


@pytest.mark.parametrize("values", [
    np.random.default_rng(4).lognormal(0, 30, 5_000), np.concatenate([np.zeros(3000), np.random.default_rng(5).normal(size=2000)]),
    np.concatenate([[-np.inf, np.inf, 1e300, -1e300], np.arange(2000) * 1e-9]),
])
def test_brackets_with_many_values_are_parted(spark, values):
    df = frame(spark, values).unionByName(frame(spark, values[:700], "b"))
    got = exact_quantiles(df, "load", PROBS, ["series_id"], accuracy=20, ordered=10, parts=8).collect()
    for row in got:
        own = np.sort(values if row["series_id"] == "a" else values[:700])
        want = [own[0], *(np.interp(p * (len(own) - 1), np.arange(len(own)), own) for p in PROBS[1:-1]), own[-1]]
        assert np.allclose([row[c] for c in ("q0", "q25", "q50", "q99", "q100")], want, rtol=1e-12, atol=1e-300)

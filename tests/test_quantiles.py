"""Selection equals sorting, whatever the values look like."""

import numpy as np
import pytest
from fluvial.operators import quantiles, stats

Q = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.987, "q10": 1.0}


def groups():
    r = np.random.default_rng(3)
    return {
        "normal": r.normal(size=300), "same": np.full(200, 7.25), "two": r.choice([1.0, 2.0], 250), "wide": np.concatenate([[-1.7e308, 1.7e308, 0.0], r.normal(size=150) * 1e-300]),
        "outlier": np.concatenate([r.random(180), [1e300]]), "small": np.array([3.0, 1.0]), "one": np.array([-5.0]), "signs": -np.exp(r.normal(size=130) * 20),
    }


@pytest.mark.parametrize("most, bins", [(1, 2), (5, 16), (64, 1024), (10_000, 1024)])
def test_selection_equals_sorting(spark, most, bins):
    want = groups()
    rows = [(k, float(x)) for k, v in want.items() for x in v] + [("normal", None), ("normal", float("nan")), ("two", float("inf")), ("none", None)]
    found = {r.k: r for r in quantiles.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", Q, most, bins).collect()}
    assert {*found} == {*want}
    for k, v in want.items():
        assert found[k].n == len(v)
        for n, q in Q.items():
            ordered, at = np.sort(v), q * (len(v) - 1)
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            exact = low if np.floor(at) == np.ceil(at) else (np.ceil(at) - at) * low + (at - np.floor(at)) * high
            assert found[k][n] == pytest.approx(exact, rel=1e-12, abs=0), (k, n)


@pytest.mark.parametrize("most", [3, 1000])
def test_one_group_of_all_rows(spark, most):
    v = np.random.default_rng(5).normal(size=400)
    rows = spark.createDataFrame([(float(x),) for x in v], "v double")
    s = stats.height_statistics(rows, "v", most=most).first()
    assert [s.p10, s.p25, s.p50, s.p75, s.p90] == pytest.approx(np.percentile(v, [10, 25, 50, 75, 90]).tolist())
    assert s.mad == pytest.approx(np.median(np.abs(v - np.median(v)))) and s.n == 400
    m = quantiles.median_deviation(rows, [], "v", most).first()
    assert (m.median, m.mad) == pytest.approx((np.median(v), s.mad))


def test_no_values(spark):
    rows = spark.createDataFrame([(None,)], "v double")
    assert quantiles.quantiles(rows, [], "v", Q, 1).collect() == []
    with pytest.raises(ValueError):
        quantiles.quantiles(rows, [], "v", {"x": 1.5})


def test_trimmed_median(spark):
    r = np.random.default_rng(6)
    want = {k: np.sort(r.normal(size=k)) for k in (1, 9, 10, 25, 40)}
    rows = spark.createDataFrame([(k, float(x)) for k, v in want.items() for x in v] + [(0, None)], "k int, v double")
    found = {x.k: x for x in stats.trimmed_median(rows, ["k"], "v").collect()}
    assert {*found} == {*want}
    for k, v in want.items():
        cut = int(k * 0.1) if k >= 10 else 0
        assert found[k].n_kept == k - 2 * cut and found[k].trimmed_median == pytest.approx(np.median(v[cut : k - cut]))

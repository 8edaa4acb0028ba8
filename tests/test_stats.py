import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsense.functions import stats
from fleetsense.operators import timeline


@pytest.fixture(params=[None, 10])
def limit(request, monkeypatch):
    """Plain windows, and the sliced form that large inputs take."""
    if request.param:
        monkeypatch.setattr(timeline, "MAX_ROWS", request.param)
    return request.param


def test_quantiles(spark, limit):
    rng = random.Random(1)
    rows = [("a" if rng.random() < .8 else "b", round(rng.gauss(0, 5), 2)) for _ in range(400)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in stats.quantiles(d, F.col("v"), [.1, .5, .9], ["p", "m", "q"], ("g",)).collect()}
    for g in "ab":
        want = np.quantile([v for k, v in rows if k == g], [.1, .5, .9])
        assert np.allclose([got[g].p, got[g].m, got[g].q], want)
    one = stats.quantiles(d, F.col("v"), [.25], ["p"]).first().p
    assert np.isclose(one, np.quantile([v for _, v in rows], .25))


def test_auc(spark, limit):
    rng = random.Random(2)
    rows = [(rng.randrange(60) / 60, rng.random() < .4) for _ in range(300)]
    d = spark.createDataFrame(rows, "p double, y boolean")
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + .5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert np.isclose(stats.auc(d, F.col("p"), F.col("y")).first().auc, want)


def test_top_by_count(spark, limit):
    rng = random.Random(3)
    rows = [(i, rng.randrange(40) / 40) for i in range(200)]
    d = spark.createDataFrame(rows, "i long, p double")
    got = {r.i for r in stats.top_by_count(d, F.col("p"), ["i"], F.lit(37)).where("chosen").collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:37]}

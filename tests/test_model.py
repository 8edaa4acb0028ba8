import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fleetsense.operators import model, training


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(1500):
        chain, duds = rng.randrange(2, 6), rng.randrange(0, 9)
        p = 1 / (1 + 2.7 ** -(0.6 * (chain - 3) + 0.3 * (duds - 4)))
        data.append((f"b{i % 50}", i, i % 12, chain, duds, float(rng.random()) if i % 9 else None, rng.random() < p))
    return spark.createDataFrame(data, "bike string, ord long, part int, chain long, hist7_duds long, shun double, y boolean").cache()


def test_generated_expression_equals_the_trained_model(rows):
    feats = ["chain", "hist7_duds", "shun"]
    fitted = model.train(rows, feats, trees=8, leaf=10)
    trees = model.from_spark(fitted, feats)
    assert len(trees["trees"]) == 8
    d = fitted.transform(model.prepared(rows, feats)).withColumn("a", vector_to_array("probability")[1]).withColumn("b", model.probability(trees))
    assert d.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("m")).first().m < 1e-9


def test_boosting_beats_the_constant(rows):
    s = training.train_and_score(rows, ["chain", "hist7_duds"], F.col("part") < 9, trees=10, leaf=10)
    e = training.evaluate(s, "gbt").first()
    assert e.auc > 0.65 and e.log_loss < 0.69
    assert training.evaluate(training.logit(rows, ["chain", "hist7_duds", "shun"], F.col("part") < 9), "l").first().auc > 0.65
    assert training.evaluate(training.small_tree(rows, ["chain", "hist7_duds"], F.col("part") < 9, leaf=20), "t").first().auc > 0.6


def test_explain_swaps_one_feature_at_a_time(spark):
    d = spark.createDataFrame([(5, 6, 10, 1, 30.0, 2.0, 1.0)], "chain long, hist7_duds long, hist7_rentals long, prior_alarms7 long, dur_sec double, age_h double, shun double")
    r = model.explain(d).first()
    assert 1 <= len(r.why) <= 3 and r.why[0].t == "chain"
    assert [abs(w.d) for w in r.why] == sorted((abs(w.d) for w in r.why), reverse=True)
    assert all(abs(w.d) >= model.WHY_MIN for w in r.why)


def test_bootstrap_is_reproducible(spark):
    rng = random.Random(2)
    data = [(i % 20, rng.random() < .5, rng.random() < .6, rng.random() < .3) for i in range(800)]
    d = spark.createDataFrame(data, "day int, y boolean, a boolean, b boolean")
    x, y = training.day_bootstrap(d, 200).first(), training.day_bootstrap(d.repartition(5), 200).first()
    assert x == y and x.lo_pct < x.hi_pct and x.replicates == 200


def test_gate(spark):
    d = spark.createDataFrame([(bool(i % 3), 0.5, 0.66) for i in range(600)], "y boolean, p double, new_p double")
    assert training.gate(d).first().switch
    assert not training.gate(d.limit(100)).first().switch
    assert not training.gate(d.withColumn("new_p", F.lit(0.5))).first().switch


def test_parts_are_months_or_equal_slices_of_all_rows(spark):
    def parts(days):
        d = spark.createDataFrame([(d,) for d in days], "s string").select(F.col("s").cast("timestamp").alias("at"))
        got, found = training.periods(d)
        return [r.part for r in got.orderBy("at").collect()], found
    assert parts(["2024-01-01", "2024-01-31", "2024-02-01", "2024-02-07", "2024-04-30"]) == ([24289, 24289, 24290, 24290, 24292], [24289, 24290, 24292])
    assert parts(["2024-01-01", "2024-01-02", "2024-01-05", "2024-01-10"]) == ([0, 0, 1, 2], [0, 1, 2])


def test_importance_equals_a_plain_shuffle_in_two_auc_passes(spark, monkeypatch):
    rng = random.Random(5)
    data = [(f"b{i % 40}", i, i % 7, rng.randrange(2, 6), rng.randrange(9), rng.random() if i % 9 else None, rng.random() < .3 + .1 * (i % 3)) for i in range(400)]
    d = spark.createDataFrame(data, "bike string, ord long, at int, chain long, hist7_duds long, shun double, y boolean")
    feats, trees = ["chain", "hist7_duds", "shun"], {"init": -.2, "scale": 1.0, "trees": [("chain", 3.5, -.4, ("hist7_duds", 4.5, .1, .7)), ("hist7_duds", 2.5, .3, -.2)]}

    def value(n, r):
        return n if isinstance(n, float) else value(n[2] if r[n[0]] <= n[1] else n[3], r)

    def plain_auc(rows):
        s = [(sum(value(t, r) for t in trees["trees"]), r["y"]) for r in rows]
        yes, no = [a for a, y in s if y], [a for a, y in s if not y]
        return sum((round(a - b, 9) > 0) + (round(a - b, 9) == 0) / 2 for a in yes for b in no) / len(yes) / len(no)

    h, wanted = d.withColumn("_h", F.xxhash64("bike", "ord", "at")), {}
    for f in feats[:2]:
        drops = []
        for r in range(3):
            one, two = (h.orderBy(F.xxhash64("_h", F.lit(0), F.lit(r), F.lit(salt), F.lit(f)), "_h").collect() for salt in (1, 2))
            drops.append(plain_auc([a.asDict() | {f: b[f]} for a, b in zip(one, two)]))
        wanted[f] = plain_auc([r.asDict() for r in h.collect()]) - sum(drops) / 3
    calls, plain = [], training.auc
    monkeypatch.setattr(training, "auc", lambda *a: calls.append(a) or plain(*a))
    got = {r.feature: r.auc_drop for r in training.permutation_importance(d, feats, trees, repeats=3).collect()}
    assert got == pytest.approx(wanted, abs=1e-9) and len(calls) == 2

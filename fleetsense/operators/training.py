"""Training, evaluation and the switch to a new model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import log_loss_term, percent
from ..functions.stats import auc, draws, quantiles
from ..rules import SETTLE_HOURS
from . import model as M
from .lists import top_per_list
from .timeline import saved

SAMPLE_COLS = ["bike", "chain", "hist7_duds", "hist7_rentals", "prior_alarms7", "dur_sec", "age_h", "shun", "p"]


def new_samples(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Training rows of the current list that are not stored yet."""
    return current.select("at", F.col("t0").alias("last_t0"), *SAMPLE_COLS).join(stored.select("at", "bike"), ["at", "bike"], "left_anti")


def settle(rows: DataFrame, now: Column, hours: int = SETTLE_HOURS) -> DataFrame:
    """Keep a label only once the deciding rental is old enough that no late record can come before it."""
    sure = F.col("next_t0") < now - F.expr(f"interval {hours} hours")
    return rows.withColumns({"next_t0": F.when(sure, F.col("next_t0")), "next_dud": F.when(sure, F.col("next_dud"))})


def conformal(lists: DataFrame, split: Column, level: float = 0.1) -> DataFrame:
    """Level quantile of z on lists before the split, and how often the bound holds after it."""
    lists = saved(lists)
    q = quantiles(lists.where(F.col("at") < split), F.col("z"), [level], ["q"]).select("q").scalar()
    ok = F.col("real") >= F.floor(F.col("mu") + q * F.col("sd"))
    test = lists.where(F.col("at") >= split)
    return test.agg(F.max(q).alias("q"), F.count("*").alias("lists"), percent(F.count_if(ok), F.count("*")).alias("covered_pct"))


def live_check(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("at").agg(F.sum("p").alias("mu"), F.count_if("y").alias("r"), F.count("*").alias("n"), F.sum("p").alias("sp"))
    return per.agg(F.sum("n").alias("n"), (F.sum("sp") / F.sum("n")).alias("p_mean"), (F.sum("r") / F.sum("n")).alias("y_mean"),
                   F.count("*").alias("lists"), F.avg("mu").alias("list_expected"), (F.sum("r") / F.count("*")).alias("list_real"))


def later_part(rows: DataFrame, share: float) -> DataFrame:
    cut = quantiles(rows, F.unix_micros("at"), [share], ["c"]).select("c").scalar()
    return rows.where(F.unix_micros("at") > cut)


def gate(test: DataFrame, margin: float = 0.98, min_n: int = 500) -> DataFrame:
    """Switch only if the new loss is clearly lower and the total is not further off, on enough labels."""
    y = F.col("y").cast("double")
    d = test.agg(F.count("*").alias("n"), F.avg(log_loss_term(y, F.col("p"))).alias("old_loss"), F.avg(log_loss_term(y, F.col("new_p"))).alias("new_loss"),
                 F.abs(F.sum("p") - F.sum(y)).alias("old_gap"), F.abs(F.sum("new_p") - F.sum(y)).alias("new_gap"))
    return d.withColumn("switch", (F.col("n") >= min_n) & (F.col("new_loss") < margin * F.col("old_loss")) & (F.col("new_gap") <= F.col("old_gap")))


def train_and_score(rows: DataFrame, features: list[str], split: Column, **params) -> DataFrame:
    """Boosting trained before the split; the rest scored by the generated expression."""
    fitted = M.train(rows.where(split), features, **params)
    trees = M.from_spark(fitted, features)
    return M.prepared(rows.where(~split), features).withColumn("p", M.probability(trees))


def _pipeline(rows: DataFrame, split: Column, stages) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    d = rows.withColumn("label", F.col("y").cast("double"))
    fitted = Pipeline(stages=stages).fit(d.where(split))
    return fitted.transform(d.where(~split)).withColumn("p", vector_to_array("probability")[1])


def logit(rows: DataFrame, features: list[str], split: Column) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    d = rows.withColumns({f: F.col(f).cast("double") for f in features})
    filled = [f"_{f}" for f in features]
    return _pipeline(d, split, [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_v"),
                                StandardScaler(inputCol="_v", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol="label", maxIter=100)])


def small_tree(rows: DataFrame, features: list[str], split: Column, leaf: int = 500) -> DataFrame:
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    d = rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    return _pipeline(d, split, [VectorAssembler(inputCols=features, outputCol="_x"),
                                DecisionTreeClassifier(featuresCol="_x", labelCol="label", maxDepth=3, minInstancesPerNode=leaf, seed=0)])


def evaluate(scored: DataFrame, name: str) -> DataFrame:
    d = saved(scored.select("p", "y"))
    a = auc(d, F.col("p"), F.col("y")).select("auc").scalar()
    return d.agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.avg("p").alias("p_mean"), (F.count_if("y") / F.count("*")).alias("y_mean"),
                 F.avg(log_loss_term(F.col("y").cast("double"), F.col("p"))).alias("log_loss"), F.max(a).alias("auc"))


def permutation_importance(rows: DataFrame, features: list[str], model: dict = M.STARTER, repeats: int = 5, seed: int = 0) -> DataFrame:
    """AUC lost when one feature is shuffled: the row at a place of one hash order gets the value of the row at the same place
    of another, inside hash buckets. All features and repeats go through one pass; a group is a feature's bucket."""
    used = [f for f in features if f in str(model["trees"])]
    if not used:        # a model of bare constants
        return rows.sparkSession.createDataFrame([], "feature string, auc_drop double")
    rows = saved(rows.withColumn("_h", F.xxhash64("bike", "ord", "at")))
    buckets = max(1, rows.count() // 100_000)
    base = auc(rows.withColumn("p", M.probability(model)), F.col("p"), F.col("y")).select("auc").scalar()
    every = rows.select("_h", F.pmod(F.col("_h"), F.lit(buckets)).alias("_b"), *[F.col(f).cast("double").alias(f) for f in features],
                        F.col("y").cast("double").alias("y"), F.explode(F.array(*[F.lit(f) for f in used])).alias("feature"))
    given, pairs = F.coalesce(*[F.when(F.col("feature") == f, F.col(f)) for f in used]), range(repeats)
    every = every.select("*", given.alias("_v"), *[F.xxhash64("_h", F.lit(seed), F.lit(r), F.lit(salt), "feature").alias(f"_o{salt}_{r}")
                                                   for r in pairs for salt in (1, 2)])
    kept = ["feature", *features, "y"]

    def mix(d):
        import numpy as np

        value, out = d["_v"].to_numpy(), d[kept].copy()
        for r in pairs:
            to, of = (np.lexsort((d["_h"].to_numpy(), d[f"_o{salt}_{r}"].to_numpy())) for salt in (1, 2))
            mixed = np.empty_like(value)
            mixed[to] = value[of]
            out[f"_m{r}"] = mixed
        return out

    schema = "feature string, " + ", ".join(f"`{c}` double" for c in [*features, "y", *(f"_m{r}" for r in pairs)])
    mixed = every.groupBy("feature", "_b").applyInPandas(mix, schema)
    # each repeat's features come out of the array as columns, so the model's expression reads them instead of repeating them
    swapped = F.array(*[F.struct(F.lit(r).alias("r"), "y", *[F.when(F.col("feature") == f, F.col(f"_m{r}")).otherwise(F.col(f)).alias(f) for f in features])
                        for r in pairs])
    mixed = mixed.select("feature", F.inline(swapped))
    d = auc(mixed.withColumn("p", M.probability(model)), F.col("p"), F.col("y"), ("feature", "r"))
    names = rows.sparkSession.createDataFrame([(f,) for f in used], "feature string")
    return names.join(d, "feature", "left").groupBy("feature").agg((F.max(base) - F.avg("auc")).alias("auc_drop"))


def day_sums(rows: DataFrame) -> DataFrame:
    """Per day: picks and hits of two selections a and b."""
    return rows.groupBy("day").agg(F.count_if("a").alias("na"), F.count_if(F.col("a") & F.col("y")).alias("ya"),
                                   F.count_if("b").alias("nb"), F.count_if(F.col("b") & F.col("y")).alias("yb"))


def day_bootstrap(rows: DataFrame, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """95 % range of the precision difference when whole days are drawn with replacement.

    Draws are hashes of (seed, replicate, position): the same on every run and on any number of executors. Only the
    day sums, one row per day, meet the replicates.
    """
    days = saved(day_sums(rows))
    n = days.count()
    numbered = days.withColumn("_d", F.row_number().over(Window.orderBy("day")) - 1)
    spark = rows.sparkSession
    plan = spark.range(replicates * n).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("j"))
    drawn = plan.withColumn("_d", draws(seed, "r", "j", F.lit(n))).join(numbered, "_d")
    per = drawn.groupBy("r").agg((F.sum("ya") / F.greatest(F.lit(1), F.sum("na")) - F.sum("yb") / F.greatest(F.lit(1), F.sum("nb"))).alias("d"))
    return per.agg(F.count("*").alias("replicates"), (100 * F.percentile("d", F.lit(0.025))).alias("lo_pct"), (100 * F.percentile("d", F.lit(0.975))).alias("hi_pct"))


def periods(rows: DataFrame, slices: int = 3) -> tuple[DataFrame, list[int]]:
    """Rows with ``part``, and the parts: calendar months, or equal time slices where all rows are of one month."""
    month = (F.year("at") * 12 + F.month("at")).cast("long")
    lo, hi, first, last = rows.agg(F.min(month), F.max(month), F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
    if lo == hi:
        month = F.least(F.lit(slices - 1), F.floor((F.unix_micros("at") - first) * slices / max(1, last - first))).cast("long")
    rows = rows.withColumn("part", month)
    return rows, sorted(r.part for r in rows.select("part").distinct().collect())


def cross_period(rows: DataFrame, features: list[str], parts: list[int], **params) -> DataFrame:
    """Train on all parts but one, test on that one, for every part."""
    out = []
    for p in parts:
        scored = train_and_score(rows, features, split=F.col("part") != p, **params)
        out.append(evaluate(scored, f"test {p}"))
    return reduce(DataFrame.unionByName, out)


def transfer(scored: DataFrame, k: int) -> DataFrame:
    """Another city under the model of the first: top-k precision by rule and by model, AUC and list coverage."""
    rule = top_per_list(scored, k, [F.desc("chain"), F.col("age_h"), F.col("bike")])
    model = top_per_list(scored, k, [F.desc("p"), F.col("bike")])

    def precision(d: DataFrame):
        return d.agg(percent(F.count_if("y"), F.count("*")).alias("v")).scalar()

    a = auc(scored, F.col("p"), F.col("y")).select("auc").scalar()
    return scored.agg(F.count("*").alias("n"), F.max(precision(rule)).alias("rule_pct"), F.max(precision(model)).alias("model_pct"), F.max(a).alias("auc"))

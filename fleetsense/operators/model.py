"""Tree models as one Column expression, explanations, training and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import FEATURES7

# A tree is a leaf value or (feature, threshold, left, right); left is taken when feature <= threshold.
# Starter model used before the first training; any trained model replaces it.
STARTER = {
    "init": -0.9,
    "scale": 1.0,
    "trees": [
        ("chain", 2.5, -0.15, ("chain", 3.5, 0.45, 0.8)),
        ("hist7_duds", 3.5, -0.2, ("hist7_rentals", 12.5, 0.35, 0.1)),
        ("prior_alarms7", -0.5, -0.1, ("prior_alarms7", 0.5, 0.0, 0.25)),
        ("dur_sec", 60.5, 0.12, -0.05),
        ("age_h", 6.0, 0.2, ("shun", 1.5, 0.05, -0.25)),
    ],
}
# Median list entry, used as the neutral value when one feature is swapped out (fixed values).
MEDIANS = {"chain": 2.0, "hist7_duds": 4.0, "hist7_rentals": 21.0, "prior_alarms7": 0.0, "dur_sec": 34.0,
           "age_h": 6.8, "shun": 2.2}
WHY_MIN = 0.02
WHY_TOP = 3


def _tree(node, value) -> Column:
    if isinstance(node, (int, float)):
        return F.lit(float(node))
    feature, cut, left, right = node
    return F.when(value(feature) <= float(cut), _tree(left, value)).otherwise(_tree(right, value))


def probability(model: dict = STARTER, swap: dict[str, float] | None = None) -> Column:
    """Logistic of the summed leaves; JVM code generation, no UDF. ``swap`` fixes some features to constants."""
    swap = swap or {}

    def value(f: str) -> Column:
        return F.lit(float(swap[f])) if f in swap else F.col(f)

    raw = F.lit(float(model["init"]))
    for t in model["trees"]:
        raw = raw + _tree(t, value)
    return 1 / (1 + F.exp(-model["scale"] * raw))


def to_sql(model: dict = STARTER) -> str:
    """The same expression as portable SQL text."""
    def text(n) -> str:
        if isinstance(n, (int, float)):
            return f"cast({float(n)!r} as double)"
        return f"case when {n[0]} <= {float(n[1])!r} then {text(n[2])} else {text(n[3])} end"

    raw = " + ".join([f"cast({float(model['init'])!r} as double)"] + [f"({text(t)})" for t in model["trees"]])
    return f"1 / (1 + exp(-{model['scale']!r} * ({raw})))"


def explain(df: DataFrame, model: dict = STARTER, medians: dict[str, float] = MEDIANS) -> DataFrame:
    """Per row the (at most three) features whose swap to the median moves p by 0.02 or more, largest first."""
    p = probability(model)
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("t"),
                               (p - probability(model, {f: medians[f]})).alias("d")) for i, f in enumerate(FEATURES7)])
    strong = F.filter(parts, lambda x: F.abs(x["d"]) >= WHY_MIN)
    ranked = F.array_sort(strong, lambda a, b: F.when(F.abs(a["d"]) > F.abs(b["d"]), -1)
                          .when(F.abs(a["d"]) < F.abs(b["d"]), 1).otherwise(a["i"] - b["i"]))
    return df.withColumn("p", p).withColumn("why", F.slice(ranked, 1, WHY_TOP))


def list_stats(df: DataFrame, p: str = "p", y: str = "y", at: str = "at", min_n: int = 10) -> DataFrame:
    """Per list time: size, expected and real hits, spread and z."""
    g = df.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("mu"),
                           F.sum(F.col(y).cast("int")).alias("real"), F.sqrt(F.sum(F.col(p) * (1 - F.col(p)))).alias("sd"))
    return g.where(F.col("n") >= min_n).withColumn("z", (F.col("real") - F.col("mu")) / F.col("sd"))


def right_closed_bin(c: Column, edges: list[float]) -> Column:
    """Upper edge of the (lo, hi] bin; null outside."""
    out = F.when((c > edges[0]) & (c <= edges[1]), F.lit(float(edges[1])))
    for lo, hi in zip(edges[1:], edges[2:]):
        out = out.when((c > lo) & (c <= hi), F.lit(float(hi)))
    return out


CALIBRATION = [0, .1, .2, .3, .4, .5, .6, .7, .8, 1]
AGES = [0, 3, 6, 12, 24]


def train(df: DataFrame, features: list[str], trees: int = 60, depth: int = 3, rate: float = 0.1, leaf: int = 200,
          seed: int = 0):
    """Gradient boosting; missing values are passed as a value below every real one."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    data = prepared(df, features).withColumn("label", F.col("y").cast("double"))
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=leaf, seed=seed,
                        featuresCol="_x", labelCol="label")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), gbt]).fit(data)


MISSING = -1.0e6


def prepared(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in features})


def from_spark(fitted, features: list[str]) -> dict:
    """Trained boosting stages as plain trees (model metadata only, a few hundred nodes)."""
    gbt = fitted.stages[-1]

    def walk(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return float(node.prediction())
        split = node.split()
        return (features[split.featureIndex()], float(split.threshold()), walk(node.leftChild()), walk(node.rightChild()))

    def scaled(t, w):
        return t * w if isinstance(t, float) else (t[0], t[1], scaled(t[2], w), scaled(t[3], w))

    trees = [scaled(walk(t._java_obj.rootNode()), w) for t, w in zip(gbt.trees, gbt.treeWeights)]
    return {"init": 0.0, "scale": 2.0, "trees": trees}

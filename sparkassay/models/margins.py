"""Regression models of the safety margin: quantile forests and a mean-and-variance model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metrics import margin_coverage_calibration, p_calibrate, quantile_shift
from ..session import durable, keyed


def _routed(model: RandomForestRegressionModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, leaves): the leaves that a row falls into, in the order of the trees."""
    return model.transform(df).select(*keep, vector_to_array(model.getLeafCol()).alias("leaves"))


def _by_tree(routed: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, tree, leaf): one row per tree."""
    return routed.select(*keep, F.posexplode("leaves").alias("tree", "leaf"))


@dataclass
class QuantileForest:
    """A forest with the weighted training values of each leaf, kept as a table."""

    model: RandomForestRegressionModel
    leaf_values: DataFrame  # tree, leaf, y, share (shares of a leaf sum to one)
    trees: int

    def _classes(self, routed: DataFrame) -> DataFrame:
        """(leaves, y, w): the distribution of every class of designs that fall into the same leaves."""
        cells = _by_tree(routed.select("leaves").distinct(), ["leaves"]).join(self.leaf_values, ["tree", "leaf"])
        return cells.groupBy("leaves", "y").agg((F.sum("share") / self.trees).alias("w"))

    def distribution(self, designs: DataFrame) -> DataFrame:
        """(gidx, y, w): predicted distribution per design, weights summing to one."""
        routed = _routed(self.model, designs, ["gidx"])
        return routed.join(keyed(self._classes(routed)), "leaves").select("gidx", "y", "w")

    def quantiles(self, designs: DataFrame, taus: list[float]) -> DataFrame:
        """(gidx, tau, q): smallest value whose cumulative weight reaches tau.

        Designs in the same leaves share a distribution, which is read once per class. It has at most trees x leaf-size
        values, so its window is bounded.
        """
        routed = _routed(self.model, designs, ["gidx"])
        w = Window.partitionBy("leaves").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
        cum = self._classes(routed).withColumn("_c", F.sum("w").over(w))
        picks = [F.min(F.when(F.col("_c") >= t - 1e-12, F.col("y"))).alias(f"_q{i}") for i, t in enumerate(taus)]
        wide = routed.join(keyed(cum.groupBy("leaves").agg(*picks, F.max("y").alias("_top"))), "leaves")
        cells = [
            F.struct(F.lit(float(t)).alias("tau"), F.coalesce(f"_q{i}", "_top").alias("q")) for i, t in enumerate(taus)
        ]
        return wide.select("gidx", F.explode(F.array(*cells)).alias("c")).select("gidx", "c.*")

    def p_below(self, designs: DataFrame, at: float = 0.0) -> DataFrame:
        """(gidx, p_unsafe): predicted mass below a margin, from one share per leaf instead of all values."""
        share = self.leaf_values.groupBy("tree", "leaf").agg(
            F.sum(F.when(F.col("y") < at, F.col("share")).otherwise(0.0)).alias("s")
        )
        routed = _routed(self.model, designs, ["gidx"])
        cells = _by_tree(routed.select("leaves").distinct(), ["leaves"]).join(share, ["tree", "leaf"])
        below = cells.groupBy("leaves").agg(F.avg("s").alias("p_unsafe"))
        return routed.join(keyed(below), "leaves").select("gidx", "p_unsafe")


def quantile_forest(
    train: DataFrame, *, trees: int = 200, min_leaf: int = 3, depth: int = 12, seed: int = 13, label: str = "margin", weight: str = "weight"
) -> QuantileForest:
    rf = RandomForestRegressor(
        featuresCol="features", labelCol=label, weightCol=weight, numTrees=trees, minInstancesPerNode=min_leaf,
        maxDepth=depth, seed=seed, leafCol="_leaf",
    ).fit(train)
    # rows with the same leaves and value are merged before the trees are spread out
    merged = _routed(rf, train, [label, weight]).groupBy("leaves", F.col(label).alias("y")).agg(F.sum(weight).alias("_w"))
    per = _by_tree(merged, ["y", "_w"]).groupBy("tree", "leaf", "y").agg(F.sum("_w").alias("_w"))
    total = per.groupBy("tree", "leaf").agg(F.sum("_w").alias("_t"))
    table = per.join(total, ["tree", "leaf"]).select("tree", "leaf", "y", (F.col("_w") / F.col("_t")).alias("share"))
    return QuantileForest(rf, durable(table), trees)  # read by every use; its rows need the whole training table


def quantile_calibrated_predict(quantiles: DataFrame, deltas: dict[float, float], taus: list[float]) -> DataFrame:
    """Add the interpolated correction of each level to the predicted quantiles."""
    shift: Column = F.lit(0.0)
    for t in taus:
        shift = F.when(F.col("tau") == float(t), F.lit(quantile_shift(t, deltas))).otherwise(shift)
    return quantiles.withColumn("q", F.col("q") + shift)


def risk_isotonic(raw: DataFrame, margins: DataFrame, *, tail_alpha: float = 1.0, tail_power: float = 1.0):
    """Monotone map from raw p_unsafe to the observed unsafe rate per design.

    Returns a function over a probability column, or None when all rates are equal.
    """
    rates = margins.groupBy("gidx").agg(F.avg((F.col("margin") < 0).cast("double")).alias("rate"))
    joined = durable(raw.join(keyed(rates), "gidx").select("p_unsafe", "rate"))
    spread = joined.agg((F.max("rate") > F.min("rate")).alias("s")).first()["s"]
    if not spread:
        return None
    grouped = joined.groupBy("p_unsafe").agg(F.avg("rate").alias("rate"), F.count(F.lit(1)).cast("double").alias("w"))
    fit = IsotonicRegression(featuresCol="p_unsafe", labelCol="rate", weightCol="w").fit(grouped)
    xs, ys = list(map(float, fit.boundaries)), list(map(float, fit.predictions))
    return lambda p: p_calibrate(p, xs, ys, tail_alpha=tail_alpha, tail_power=tail_power)


@dataclass
class MarginModel:
    """Mean and log-variance forests; the spread of the mean's trees is the epistemic part."""

    mean: RandomForestRegressionModel
    log_var: RandomForestRegressionModel
    leaf_means: DataFrame
    bias: float = 0.0
    scale: float = 1.0

    def predict(self, designs: DataFrame) -> DataFrame:
        """(gidx, mu, var_epistemic, var_noise, var)."""
        noisy = self.log_var.transform(designs).withColumn("var_noise", F.exp("prediction")).select(*designs.columns, "var_noise")
        routed = _routed(self.mean, noisy, ["gidx", "var_noise"])
        cells = _by_tree(routed.select("leaves").distinct(), ["leaves"]).join(self.leaf_means, ["tree", "leaf"])
        spread = cells.groupBy("leaves").agg(F.avg("m").alias("mu"), F.var_pop("m").alias("var_epistemic"))
        out = routed.join(keyed(spread), "leaves").withColumn("var", F.col("var_epistemic") + F.col("var_noise"))
        return out.select("gidx", "mu", "var_epistemic", "var_noise", "var")


def hetero_margin_model(
    stats: DataFrame, calib: DataFrame, calib_margins: DataFrame, *, trees: int = 100, depth: int = 8, gamma: float = 0.9, seed: int = 13,
    family: str = "gaussian", df: float = 5.0,
) -> MarginModel:
    """Fit on per-design statistics (features, y, alpha, log_var, n) and calibrate the coverage.

    The mean forest weighs a design by the inverse noise of its mean, the variance forest by its size.
    """
    args = dict(featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    weighted = stats.withColumn("_wm", 1.0 / F.col("alpha")).withColumn("_wv", F.col("n").cast("double"))
    mean = RandomForestRegressor(labelCol="y", weightCol="_wm", leafCol="_leaf", **args).fit(weighted)
    log_var = RandomForestRegressor(labelCol="log_var", weightCol="_wv", **args).fit(weighted)
    routed = _by_tree(_routed(mean, weighted, ["y", "_wm"]), ["y", "_wm"])
    means = routed.groupBy("tree", "leaf").agg((F.sum(F.col("y") * F.col("_wm")) / F.sum("_wm")).alias("m"))
    model = MarginModel(mean, log_var, means)
    predicted = durable(model.predict(calib).select("gidx", "mu", "var"))
    fit = margin_coverage_calibration(predicted, calib_margins, gamma, family, df).first()
    model.bias, model.scale = float(fit["bias"]), float(fit["scale"])
    return model

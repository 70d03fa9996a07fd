"""Thresholds, decision curves, calibrators and abstention."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.vectors import binary_entropy
from cohortloom.operators.cohorts import ContractError
from cohortloom.operators.metrics import at_threshold, curve

#: Columns that an isotonic model reads and makes.
FEATURE, OUTPUT = "_calibrator_in", "_calibrator_out"


def select_threshold(rows: DataFrame, how: str = "youden", least: float = 0.9) -> DataFrame:
    """One row (threshold, value): the best distinct probability, ties to the lowest; 0.5 where none is feasible.

    how: youden, balanced_accuracy, sensitivity_constrained (sensitivity at least `least`, best specificity) or
    specificity_constrained (the reverse).
    """
    sens, spec = F.col("tp") / F.col("pos"), 1 - F.col("fp") / F.col("neg")
    value = {"youden": sens + spec - 1, "balanced_accuracy": (sens + spec) / 2, "sensitivity_constrained": F.when(sens >= least, spec), "specificity_constrained": F.when(spec >= least, sens)}[how]
    ranked = curve(rows).where("pos > 0 and neg > 0").select("t", F.round(value, 12).alias("value")).where("value is not null")
    best = ranked.groupBy().agg(F.max_by("t", F.struct("value", -F.col("t"))).alias("t"), F.max("value").alias("value"))
    return best.select(F.coalesce("t", F.lit(0.5)).alias("threshold"), "value")


def decision_curve(rows: DataFrame, steps: int = 99) -> DataFrame:
    """(t, model, treat_all, treat_none): net benefit at t = 0.01, 0.02, ...

    Rows are first counted per threshold interval, so that the thresholds meet `steps` rows and not all of them.
    """
    grid = rows.sparkSession.range(1, steps + 1).select((F.col("id") / (steps + 1)).alias("t"))
    k = F.floor(F.col("y_prob") * (steps + 1) + 1e-9)
    counts = rows.groupBy(k.alias("k")).agg(F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") != 1).alias("q"))
    at = grid.join(F.broadcast(counts), F.col("k") >= F.round(F.col("t") * (steps + 1)), "left").groupBy("t").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("q"), F.lit(0)).alias("fp"))
    n = counts.agg(F.sum(F.col("p") + F.col("q")).alias("n"), F.sum("p").alias("pos"))
    odds = F.col("t") / (1 - F.col("t"))
    return at.join(F.broadcast(n)).select("t", ((F.col("tp") - F.col("fp") * odds) / F.col("n")).alias("model"), ((F.col("pos") - (F.col("n") - F.col("pos")) * odds) / F.col("n")).alias("treat_all"), F.lit(0.0).alias("treat_none"))


def method_for(n: int, n_classes: int) -> str:
    """isotonic from 200 rows, sigmoid from 20, else none; none where one class occurs."""
    return "none" if n_classes < 2 or n < 20 else "isotonic" if n >= 200 else "sigmoid"


@dataclass
class Calibrator:
    """A fitted map of probabilities: none, sigmoid (slope and constant) or isotonic (Spark's model, which interpolates between its steps)."""

    method: str
    slope: float = 0.0
    constant: float = 0.0
    model: IsotonicRegressionModel | None = None

    def apply(self, rows: DataFrame, column: str = "y_prob") -> DataFrame:
        """rows with the column calibrated."""
        if self.method == "sigmoid":
            return rows.withColumn(column, 1 / (1 + F.exp(-(F.lit(self.slope) * F.col(column) + self.constant))))
        if self.method == "isotonic":
            return self.model.transform(rows.withColumn(FEATURE, F.col(column).cast("double"))).withColumn(column, F.col(OUTPUT)).drop(FEATURE, OUTPUT)
        return rows

    def describe(self) -> dict:
        """What identifies it: the numbers, or a digest of the steps."""
        steps = [] if self.model is None else [[float(x) for x in self.model.boundaries], [float(y) for y in self.model.predictions]]
        return {"method": self.method, "slope": self.slope, "constant": self.constant, "steps": hashlib.sha256(json.dumps(steps).encode()).hexdigest()}


def fit_calibrator(rows: DataFrame, method: str | None = None) -> Calibrator:
    """Fitted on (y_true, y_prob); equal probabilities are one weighted row of the isotonic fit."""
    n = rows.agg(F.count("*").alias("n"), F.count_distinct("y_true").alias("k")).first()
    method = method or method_for(n["n"], n["k"])
    data = rows.select(F.col("y_true").cast("double").alias("label"), F.col("y_prob").cast("double").alias(FEATURE))
    if method == "isotonic":
        weighted = data.groupBy(FEATURE).agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("w"))
        return Calibrator(method, model=IsotonicRegression(featuresCol=FEATURE, labelCol="label", weightCol="w", predictionCol=OUTPUT).fit(weighted))
    if method == "sigmoid":
        model = LogisticRegression(regParam=1.0 / n["n"], standardization=False, maxIter=200, tol=1e-10).fit(data.select("label", array_to_vector(F.array(FEATURE)).alias("features")))
        return Calibrator(method, float(model.coefficients[0]), float(model.intercept))
    return Calibrator("none")


@dataclass(frozen=True)
class FrozenPolicy:
    """A calibrator and a threshold, both from development rows, bound by a fingerprint; it may judge test rows once."""

    calibrator: Calibrator
    threshold: float
    strategy: str
    used: list = field(default_factory=list, compare=False)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps({"calibrator": self.calibrator.describe(), "threshold": self.threshold, "strategy": self.strategy}, sort_keys=True).encode()).hexdigest()

    def evaluate(self, test: DataFrame, by: list[str] = ()) -> DataFrame:
        """(by, metrics at the threshold, threshold) of test rows; a second call is an error."""
        if self.used:
            raise ContractError("this policy has judged its test rows")
        self.used.append(True)
        return at_threshold(self.calibrator.apply(test), self.threshold, by).withColumn("threshold", F.lit(self.threshold))


def freeze(development: DataFrame, strategy: str = "youden", method: str | None = None, least: float = 0.9) -> FrozenPolicy:
    """The policy that (y_true, y_prob) of development rows give."""
    fitted = fit_calibrator(development, method)
    return FrozenPolicy(fitted, float(select_threshold(fitted.apply(development), strategy, least).first()["threshold"]), strategy)


def uncertainty(rows: DataFrame) -> DataFrame:
    """Adds entropy (nats), confidence and the log odds of y_prob."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("y_prob")))
    return rows.withColumns({"entropy": binary_entropy(F.col("y_prob")), "confidence": F.greatest(p, 1 - p), "logit": F.log(p / (1 - p) + 1e-12)})


def abstention_threshold(development: DataFrame, coverage: float, by: list[str] = ()) -> DataFrame:
    """(by, t): the quantile of uncertainty that keeps the given share."""
    return development.groupBy(*by).agg(F.percentile("u", coverage).alias("t"))


def apply_abstention(rows: DataFrame, threshold: DataFrame) -> DataFrame:
    """One row (t, n, retained, accuracy) over rows (u, y_true, y_prob): accuracy, with halves rounded to even, of what is kept."""
    hit = (F.bround("y_prob", 0).cast("int") == F.col("y_true")).cast("double")
    kept = F.col("u") <= F.col("t")
    return rows.join(F.broadcast(threshold)).groupBy("t").agg(F.count("*").alias("n"), F.count_if(kept).alias("retained"), F.avg(F.when(kept, hit)).alias("accuracy"))


def pairs_summary(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Wins, ties and losses, mean, sample deviation and effect size of (a, b) pairs; ties within 1e-9."""
    x = F.col("a") - F.col("b")
    return pairs.where("a is not null and b is not null").groupBy(*by).agg(
        F.count_if(x > 1e-9).alias("wins"), F.count_if(F.abs(x) <= 1e-9).alias("ties"), F.count_if(x < -1e-9).alias("losses"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), (F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0))).alias("effect"))


"""Baselines and classifiers as pyspark.ml wrappers, out-of-fold prediction, nested selection, held-out sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from cohortloom.functions.vectors import dot, softmax, total
from cohortloom.operators.cohorts import ContractError, require_none
from cohortloom.operators.metrics import ranking_metrics

#: Parameters that are searched for each candidate.
SEARCH = {"logistic": {"regParam": [0.01, 0.1, 1.0]}, "random_forest": {"maxDepth": [3, 5]}, "gradient_boosting": {"maxDepth": [2, 3]}}


@dataclass
class Fitted:
    """predict adds y_prob, the probability of class 1 (binary) or the predicted class's, and y_pred."""

    name: str
    predict: Callable[[DataFrame], DataFrame]
    model: object = None


def _constant(name: str, prob: float, pred: float) -> Fitted:
    return Fitted(name, lambda df: df.withColumns({"y_prob": F.lit(prob), "y_pred": F.lit(pred)}))


def _weights(label: str, counts: dict[float, int]) -> Column:
    """n / (K c) for each class c."""
    n, k = sum(counts.values()), len(counts)
    out = F.lit(1.0)
    for value, c in counts.items():
        out = F.when(F.col(label) == value, n / (k * c)).otherwise(out)
    return out


def fit_candidate(train: DataFrame, kind: str, seed: int = 0, label: str = "y_true", features: str = "features", **params) -> Fitted:
    """majority, prevalence, centroid (two classes), logistic, random_forest, gradient_boosting or small_mlp; one class alone gives a constant.

    train: label (double from 0) and a vector column. Class weights are inverse to frequency; features are scaled on train alone.
    """
    base = train.select(F.col(label).cast("double").alias("label"), F.col(features)).persist()
    try:
        return _fit(base, kind, seed, features, params)
    finally:
        base.unpersist()


def _fit(base: DataFrame, kind: str, seed: int, features: str, params: dict) -> Fitted:
    counts = {r["label"]: r["count"] for r in base.groupBy("label").count().collect()}
    top = min((-c, v) for v, c in counts.items())[1]
    share = counts.get(1.0, 0) / sum(counts.values())
    if kind == "majority" or len(counts) == 1:
        return _constant(kind, 1.0 if top == 1.0 else 0.0, top)
    if kind == "prevalence":
        return _constant(kind, share, top)
    if kind == "centroid":
        return _centroid(base, features)
    data = base.withColumn("w", _weights("label", counts))
    scaler = StandardScaler(inputCol=features, outputCol="_scaled", withMean=True, withStd=True)
    k = int(max(counts)) + 1
    if kind == "logistic":
        est = LogisticRegression(featuresCol="_scaled", weightCol="w", **({"regParam": 0.1, "maxIter": 30, "tol": 1e-4} | params))
    elif kind == "random_forest":
        est = RandomForestClassifier(featuresCol="_scaled", weightCol="w", seed=seed, **({"numTrees": 50} | params))
    elif kind == "gradient_boosting":
        est = GBTClassifier(featuresCol="_scaled", weightCol="w", seed=seed, **({"maxIter": 20} | params))
        if k > 2:
            est = OneVsRest(classifier=est, featuresCol="_scaled", weightCol="w")
    elif kind == "small_mlp":
        size = len(base.select(vector_to_array(features).alias("x")).first()["x"])
        est = MultilayerPerceptronClassifier(featuresCol="_scaled", layers=[size, 32, k], seed=seed, **({"maxIter": 60} | params))
    else:
        raise ValueError(f"no candidate {kind}")
    model = Pipeline(stages=[scaler, est]).fit(data)

    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        prob = F.element_at(vector_to_array("probability"), 2) if "probability" in out.columns else F.col("prediction")
        return out.withColumns({"y_prob": prob.cast("double"), "y_pred": F.col("prediction")}).select(*df.columns, "y_prob", "y_pred")

    return Fitted(kind, predict, model)


def _centroid(base: DataFrame, features: str) -> Fitted:
    """The nearest of two class means: the logistic of half the difference of squared distances. Deterministic and without search."""
    w, c = _between(_class_means(base, [], "label", features))

    def predict(df: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-(dot(vector_to_array(features), F.array(*map(F.lit, w))) + F.lit(c))))
        return df.withColumn("y_prob", p).withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("double"))

    return Fitted("centroid", predict)


def _class_means(rows: DataFrame, by: list[str], label: str, features: str) -> list:
    """Rows (by, label, n, m) of the classes' means in each group; groups are few."""
    return rows.groupBy(*by, F.col(label).cast("double").alias("label")).agg(F.count("*").alias("n"), Summarizer.mean(F.col(features)).alias("m")).collect()


def _between(means: list) -> tuple[list[float], float]:
    """The weights and the constant of the logit between class 1 and the others."""
    sides = []
    for own in ([r for r in means if r["label"] == 1.0], [r for r in means if r["label"] != 1.0]):
        if not own:
            raise ContractError("centroid needs two classes, of which one is 1")
        sides.append(sum(r["n"] * r["m"].toArray() for r in own) / sum(r["n"] for r in own))
    a, b = sides
    return (a - b).tolist(), float((b**2 - a**2).sum() / 2)


#: Candidates that are fitted from counts and means of classes alone.
BY_CLASS = ("majority", "prevalence", "centroid")


def apart(rows: DataFrame, kind: str, by: str, within: tuple[str, ...] = (), label: str = "y_true", features: str = "features") -> DataFrame:
    """Each row predicted once, by a model of BY_CLASS that is fitted to the other groups `by` of its own `within`; both are a small number of values.

    What every model needs is sums over the groups it may see, so one pass sums up each group and one predicts, however many there are.
    """
    keys, found = [*within, by], _class_means(rows, [*within, by], label, features)
    fitted = []
    for at in dict.fromkeys(tuple(r[k] for k in keys) for r in found):
        seen = [r for r in found if tuple(r[k] for k in within) == at[:-1] and r[by] != at[-1]]
        if not seen:
            raise ContractError("a group of all rows leaves none to fit on")
        counts = {}
        for r in seen:
            counts[r["label"]] = counts.get(r["label"], 0) + r["n"]
        top, share = min((-c, v) for v, c in counts.items())[1], counts.get(1.0, 0) / sum(counts.values())
        if kind == "centroid" and len(counts) > 1:
            fitted.append((*at, *_between(seen), None, None))
        else:
            fitted.append((*at, None, None, share if kind == "prevalence" and len(counts) > 1 else float(top == 1.0), top))
    kinds = StructType([rows.schema[k] for k in keys] + [StructField("_w", ArrayType(DoubleType())), *(StructField(c, DoubleType()) for c in ("_c", "_prob", "_pred"))])
    scored = rows.join(F.broadcast(rows.sparkSession.createDataFrame(fitted, kinds)), keys)
    p = F.coalesce("_prob", 1 / (1 + F.exp(-(dot(vector_to_array(features), F.col("_w")) + F.col("_c")))))
    return scored.withColumn("y_prob", p).withColumn("y_pred", F.coalesce("_pred", (F.col("y_prob") >= 0.5).cast("double"))).select(*rows.columns, "y_prob", "y_pred")


CANDIDATES = ("majority", "prevalence", "centroid", "logistic", "random_forest", "gradient_boosting", "small_mlp", "attention", "module_attention")


def candidate_kind(name: str, n_classes: int, has_modules: bool) -> str:
    """The candidate that a configured name stands for, or an error where the data cannot carry it."""
    name = {"lr": "logistic", "rf": "random_forest", "gbt": "gradient_boosting", "mlp": "small_mlp"}.get(name.strip().lower(), name.strip().lower())
    if name not in CANDIDATES:
        raise ContractError(f"no candidate {name}")
    if name.startswith("module") and not has_modules:
        raise ContractError(f"{name} needs modules")
    if name in ("centroid", "attention", "module_attention") and n_classes != 2:
        raise ContractError(f"{name} needs two classes")
    return name


#: Training strategies, and candidates that are trained by others than the first (fixed values).
STRATEGIES, MODULE_BASED = ("erm", "source_balanced", "coral", "mmd", "domain_adversarial"), ("module_attention",)


def applied_strategies(runs: DataFrame) -> DataFrame:
    """runs with (applied, applicable): what the winner (candidate) of a run was trained by, given the strategy it asked for.

    A candidate without modules is trained plainly whatever was asked, and such a run is no evidence for the strategy. Unknown
    candidates and strategies are an error.
    """
    known, few = runs.select("candidate", "strategy").distinct(), F.col("strategy").isin(*STRATEGIES)
    unknown = ~F.coalesce(few & F.col("candidate").isin(*CANDIDATES), F.lit(False))
    require_none(known, unknown, "unknown candidates or strategies")
    applicable = F.col("candidate").isin(*MODULE_BASED) | (F.col("strategy") == STRATEGIES[0])
    return runs.withColumn("applied", F.when(applicable, F.col("strategy")).otherwise(STRATEGIES[0])).withColumn("applicable", applicable)


def out_of_fold(rows: DataFrame, kind: str, seed: int = 0, **params) -> DataFrame:
    """Each row predicted once, by a model of the other folds; rows has `fold`, a small number of values."""
    if kind in BY_CLASS:
        return apart(rows, kind, "fold")
    out = None
    for k in sorted(r["fold"] for r in rows.select("fold").distinct().collect()):
        part = fit_candidate(rows.where(F.col("fold") != k), kind, seed, **params).predict(rows.where(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def nested_selection(rows: DataFrame, kind: str, seed: int = 0) -> list[dict]:
    """For each outer fold, the parameters with the best mean inner AUROC, chosen without the outer fold's rows."""
    chosen, grid = [], SEARCH[kind]
    (name, values), folds = next(iter(grid.items())), sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    for outer in folds:
        development, best = rows.where(F.col("fold") != outer), None
        for v in values:
            score = ranking_metrics(out_of_fold(development, kind, seed, **{name: v})).first()["auroc"]
            if score is not None and (best is None or score > best[0]):
                best = (score, v)
        chosen.append({"outer": outer, name: best[1] if best else values[0], "auroc": best[0] if best else None})
    return chosen


def leave_one_source_out(rows: DataFrame, kind: str, seed: int = 0) -> DataFrame:
    """(source, n, auroc, auprc): each source predicted by a model of the others."""
    if kind in BY_CLASS:
        out = apart(rows, kind, "source")
    else:
        out = None
        for s in sorted(r["source"] for r in rows.select("source").distinct().collect()):
            part = fit_candidate(rows.where(F.col("source") != s), kind, seed).predict(rows.where(F.col("source") == s))
            out = part if out is None else out.unionByName(part)
    return ranking_metrics(out, ["source"]).join(out.groupBy("source").agg(F.count("*").alias("n")), "source")


def linear_scores(features: DataFrame, weights: list[list[float]], constants: list[float]) -> DataFrame:
    """Adds `scores`, softmax of weights times x, to rows with an array x: a forward pass as an expression."""
    rows = F.array(*(dot(F.col("x"), F.array(*map(F.lit, w))) + F.lit(c) for w, c in zip(weights, constants, strict=True)))
    return features.withColumn("scores", softmax(rows))


def gated_attention(cells: DataFrame, v: list[list[float]], u: list[list[float]], w: list[float]) -> DataFrame:
    """Adds `score`: w . (tanh(V x) * sigmoid(U x)) of each cell's array x."""
    parts = [F.lit(c) * F.tanh(dot(F.col("x"), F.array(*map(F.lit, a)))) / (1 + F.exp(-dot(F.col("x"), F.array(*map(F.lit, b))))) for a, b, c in zip(v, u, w, strict=True)]
    return cells.withColumn("score", total(F.array(*parts)))


def focal_loss(p: Column, y: Column, gamma: float = 2.0) -> Column:
    """-(1 - p_t)^gamma ln p_t of a binary probability."""
    pt = F.when(y == 1, p).otherwise(1 - p)
    return -F.pow(1 - pt, F.lit(gamma)) * F.log(F.greatest(pt, F.lit(1e-12)))


def masked_mean(loss: Column, known: Column) -> Column:
    """Aggregate: the mean over rows that are known, 0 where none is."""
    return F.coalesce(F.avg(F.when(known, loss)), F.lit(0.0))


def hierarchical_pool(cells: DataFrame) -> DataFrame:
    """(subject_id, x): means within each cell type, then over the subject's types, so a common type doesn't drown others; cells is (subject_id, cell_type_id, gene, value)."""
    types = cells.groupBy("subject_id", "cell_type_id", "gene").agg(F.avg("value").alias("value"))
    return types.groupBy("subject_id", "gene").agg(F.avg("value").alias("value"))


def final_rank(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("metric"), "candidate")))  # a row a candidate

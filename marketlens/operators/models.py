"""Churn, lifetime value and conversion models on Spark ML.

Every candidate is one ``Pipeline`` (assemble, scale, estimate), so a chosen model scores
raw feature rows and the scaling can never be forgotten. Training rows are checkpointed
once: estimators pass over them many times, and a lost executor must not re-derive them
from the facts.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from marketlens.functions.numbers import fixed
from marketlens.functions.rows import spread
from marketlens.operators.features import (
    TARGETS, banded, classification_report, curve_points, feature_matrix, with_split,
)
from marketlens.operators.newton import NewtonTrees
from marketlens.plans.tables import Tables
from marketlens.session import checkpoint_dir

KINDS = tuple(TARGETS)
NOT_FEATURES = ("customer_id", "favorite_sport", "is_test", *TARGETS.values())

# Features that restate a label and so are left out of its model by default.
LEAKS: dict[str, tuple[str, ...]] = {
    "churn": ("days_since_last_bet", "days_since_last_transaction", "bets_last_30d",
              "wagered_last_30d", "active_days_last_30d"),
    "ltv": ("gross_gaming_revenue", "acquisition_cost", "net_betting_result", "total_winnings",
            "total_wagered"),
    "conversion": ("has_made_deposit", "total_deposits", "net_deposits", "num_deposits",
                   "avg_deposit_size", "first_deposit_amount", "deposit_frequency",
                   "days_to_first_deposit", "days_since_last_transaction",
                   "transaction_span_days"),
}


@dataclass
class Trained:
    """Candidates of one kind, their metrics, and the best one's held-out predictions."""

    kind: str
    features: list[str]
    models: dict[str, PipelineModel] = field(default_factory=dict)
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)
    best: str | None = None
    predictions: DataFrame | None = None

    @property
    def best_model(self) -> PipelineModel | None:
        return self.models.get(self.best) if self.best else None


def feature_names(matrix: DataFrame, kind: str, leak_free: bool = True) -> list[str]:
    dropped = set(NOT_FEATURES) | (set(LEAKS[kind]) if leak_free else set())
    return [c for c in matrix.columns if c not in dropped]


# Features that stay NULL in the matrix; a model sees their mean and a flag instead.
MAY_BE_MISSING = ("age",)


def plain_rows(matrix: DataFrame) -> DataFrame:
    """Decimals as doubles, and a flag for each feature that may be missing."""
    plain = matrix.select(*[
        F.col(name).cast("double").alias(name) if dtype.startswith("decimal") else F.col(name)
        for name, dtype in matrix.dtypes])
    return plain.withColumns({
        f"{c}_missing": F.col(c).isNull().cast("double") for c in MAY_BE_MISSING})


def prepare_stages(matrix: DataFrame, names: Sequence[str]) -> list:
    """Index remaining strings, fill what may be missing, assemble, scale.

    The means are learned from the rows the stages are fitted on; no row is left out.
    """
    kinds = dict(matrix.dtypes)
    strings = [c for c in names if kinds[c] == "string"]
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep")
                for c in strings]
    missing = [c for c in names if c in MAY_BE_MISSING]
    imputers = [Imputer(inputCols=missing, outputCols=[f"{c}_filled" for c in missing])
                ] if missing else []
    inputs = [f"{c}_index" if c in strings else f"{c}_filled" if c in missing else c for c in names]
    return [*indexers, *imputers,
            VectorAssembler(inputCols=inputs, outputCol="raw_features", handleInvalid="error"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]


def classifiers(trees: int, rounds: int, seed: int) -> dict:
    """A forest, a linear model, and two kinds of boosted trees: by gradients over raw values, and by
    Newton's steps over binned values."""
    return {
        "RandomForest": RandomForestClassifier(numTrees=trees, seed=seed),
        "NewtonTrees": NewtonTrees(logistic=True, rounds=max(rounds // 3, 1)),
        "LogisticRegression": LogisticRegression(),
        "BoostedTrees": GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.1, seed=seed),
    }


def regressors(trees: int, rounds: int, seed: int) -> dict:
    return {
        "RandomForest": RandomForestRegressor(numTrees=trees, seed=seed),
        "NewtonTrees": NewtonTrees(logistic=False, rounds=max(rounds // 3, 1)),
        "Ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0),
        "LinearRegression": LinearRegression(),
    }


def shared_matrix(t: Tables) -> DataFrame:
    """Features and all targets with decimals as doubles, checkpointed for all kinds of models."""
    plain = plain_rows(feature_matrix(t))
    checkpoint_dir(plain.sparkSession)
    return plain.checkpoint()


def training_rows(t: Tables, kind: str, seed: int = 42, matrix: DataFrame | None = None) -> DataFrame:
    """Features, target and split flag with decimals as doubles, checkpointed.

    ``matrix`` is the ``shared_matrix`` where one is at hand.
    """
    if matrix is None:
        plain = plain_rows(feature_matrix(t, kind))
    else:
        plain = matrix.drop(*[c for k, c in TARGETS.items() if k != kind])
    if kind == "ltv":
        plain = plain.where("has_made_deposit = 1")
    checkpoint_dir(plain.sparkSession)
    stratum = None if kind == "ltv" else TARGETS[kind]
    return spread(with_split(plain, seed, label=stratum).withColumn(
        "label", F.col(TARGETS[kind]).cast("double")).checkpoint(), "customer_id")


def train(t: Tables, kind: str, *, trees: int = 100, rounds: int = 100, seed: int = 42,
          leak_free: bool = True, matrix: DataFrame | None = None) -> Trained:
    """Fit all candidates on the training share and keep the best on the held-out share.

    Classification is ranked by area under ROC, regression by R2. Without rows (no
    depositors) the result is empty. The candidates are fitted side by side: each consists of
    hundreds of short jobs, which leave cores idle one after another.
    """
    if kind not in KINDS:
        raise ValueError(f"Unknown model kind: {kind}. Available: {list(KINDS)}")
    rows = training_rows(t, kind, seed, matrix)
    names = feature_names(rows.drop("label"), kind, leak_free)
    result = Trained(kind, names)
    fitted, held = rows.where("NOT is_test"), rows.where("is_test")
    if fitted.isEmpty() or held.isEmpty():
        return result
    regression = kind == "ltv"
    labels = fitted.select("label").distinct().limit(2).count()
    if not regression and labels < 2:
        return result
    # fitted once: the preparation is the same for every candidate
    preparation = Pipeline(stages=prepare_stages(rows, names)).fit(fitted)
    train_rows = preparation.transform(fitted).select("label", "features").persist()
    try:
        candidates = (regressors if regression else classifiers)(trees, rounds, seed)

        @inheritable_thread_target(rows.sparkSession)
        def fit(name: str) -> tuple[PipelineModel, dict[str, float]]:
            model = PipelineModel([*preparation.stages, candidates[name].fit(train_rows)])
            return model, _measure(model.transform(held), regression)

        train_rows.count()  # once for all candidates
        with ThreadPoolExecutor(len(candidates)) as pool:
            for name, (model, metrics) in zip(candidates, pool.map(fit, candidates), strict=True):
                result.models[name], result.metrics[name] = model, metrics
    finally:
        train_rows.unpersist()
    order = "r2" if regression else "auc"
    result.best = max(result.metrics, key=lambda m: result.metrics[m][order])
    result.predictions = result.models[result.best].transform(held)
    return result


def _measure(predictions: DataFrame, regression: bool) -> dict[str, float]:
    if regression:
        return {m: RegressionEvaluator(metricName=m).evaluate(predictions)
                for m in ("r2", "rmse", "mae")}
    return {"auc": BinaryClassificationEvaluator().evaluate(predictions)}


def model_comparison(trained: Trained, spark: SparkSession) -> DataFrame:
    """One row per candidate and metric; a handful of rows."""
    rows = [(trained.kind, name, metric, float(value), name == trained.best)
            for name, metrics in trained.metrics.items() for metric, value in metrics.items()]
    return spark.createDataFrame(
        rows, "model_type string, candidate string, metric string, value double, is_best boolean")


def best_tree(trained: Trained) -> str | None:
    """The best candidate that ranks its features."""
    order = "r2" if trained.kind == "ltv" else "auc"
    trees = [n for n, m in trained.models.items() if hasattr(m.stages[-1], "featureImportances")]
    return max(trees, key=lambda n: trained.metrics[n][order]) if trees else None


def feature_importance(trained: Trained, spark: SparkSession) -> DataFrame:
    """Importances of the best tree model, one row per feature."""
    name = best_tree(trained)
    values = trained.models[name].stages[-1].featureImportances.toArray() if name else []
    ranked = sorted(zip(trained.features, map(float, values)), key=lambda p: (-p[1], p[0]))
    rows = [(trained.kind, name, f, v, i) for i, (f, v) in enumerate(ranked, 1)]
    return spark.createDataFrame(
        rows, "model_type string, candidate string, feature string, importance double, rank int")


def scaling(trained: Trained, spark: SparkSession) -> DataFrame:
    """Mean and deviation that the scaler learned per feature."""
    scaler = next(iter(trained.models.values())).stages[-2]
    rows = [(f, float(m), float(s)) for f, m, s in
            zip(trained.features, scaler.mean.toArray(), scaler.std.toArray())]
    return spark.createDataFrame(rows, "feature string, mean double, std double")


def probability() -> Column:
    return vector_to_array("probability")[1]


def test_report(trained: Trained) -> DataFrame:
    return classification_report(trained.predictions)


def test_curves(trained: Trained) -> DataFrame:
    return curve_points(trained.predictions.select("label", probability().alias("score")))


def residuals(trained: Trained) -> DataFrame:
    return trained.predictions.select(
        "customer_id", F.col("label").alias("actual"), F.col("prediction").alias("predicted"),
        (F.col("label") - F.col("prediction")).alias("residual"))


def risk_scores(t: Tables, models: dict[str, Transformer | None],
                customer_ids: DataFrame | None = None, matrix: DataFrame | None = None) -> DataFrame:
    """Churn, value and conversion scores with bands for all or the given customers.

    ``customer_ids`` is a frame with that column. A missing model leaves its published
    defaults: no churn probability, value 0, conversion 0 or 1. ``matrix`` is the
    ``shared_matrix`` where one is at hand.
    """
    if matrix is None:
        matrix = plain_rows(feature_matrix(t, "churn"))
    matrix = matrix.drop(*TARGETS.values())
    if customer_ids is not None:
        matrix = matrix.join(customer_ids.select("customer_id").distinct(), "customer_id",
                             "left_semi")
    who = t.customers.select("customer_id", "customer_segment")
    matrix = matrix.join(who, "customer_id")
    # three models read the same features; a written copy also keeps the plans short
    checkpoint_dir(matrix.sparkSession)
    scored = spread(matrix.checkpoint(), "customer_id")
    outputs = {"churn": ("churn_probability", probability()), "conversion": (
        "conversion_score", probability()), "ltv": ("ltv_prediction", F.col("prediction"))}
    defaults = {"churn": F.lit(None).cast("double"), "conversion": F.lit(0.0), "ltv": F.lit(0.0)}
    for kind, (name, value) in outputs.items():
        model = models.get(kind)
        if model is None:
            scored = scored.withColumn(name, defaults[kind])
        else:
            columns = scored.columns
            scored = model.transform(scored).select(*columns, value.alias(name))
    return banded(scored)


def risk_distribution(scores: DataFrame) -> DataFrame:
    """Customers per band of each score, with the mean predicted value."""
    bands = F.explode(F.array(*[
        F.struct(F.lit(c).alias("score"), F.col(c).alias("band"))
        for c in ("churn_risk", "ltv_segment", "conversion_potential")])).alias("b")
    return scores.select("predicted_ltv", bands).groupBy("b.score", "b.band").agg(
        F.count("*").alias("customers"), fixed(F.avg("predicted_ltv"), 6)
        .alias("avg_predicted_ltv"))


def save_models(models: dict[str, PipelineModel], folder: str) -> None:
    for kind, model in models.items():
        model.write().overwrite().save(f"{folder}/{kind}")


def load_models(folder: str, kinds: Sequence[str] = KINDS) -> dict[str, PipelineModel]:
    return {kind: PipelineModel.load(f"{folder}/{kind}") for kind in kinds}

"""Classifiers of rare events: boosted trees and logistic regression, calibrated, with contributions by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagegrid.functions.numbers import half_up, sigmoid
from triagegrid.operators import ranking


def class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """df with rows / (2 * rows of the class), so that both classes weigh alike."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    return df.join(F.broadcast(counts), label).crossJoin(F.broadcast(total)).withColumn(name, F.col("__n") / (F.col("__c") * 2.0)).drop("__c", "__n")


def fit_logistic(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Standardised features, balanced classes."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1e-3, standardization=False, maxIter=100),
    ]
    return Pipeline(stages=stages).fit(class_weight(train, label))


def fit_trees(train: DataFrame, validation: DataFrame, features: Sequence[str], label: str, rounds: int = 600, step: float = 0.03, depth: int = 5, least: int = 40, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees with balanced classes, fitted once, of which the first k are kept, k by average precision on validation.

    Every prefix of the ensemble is measured, all in one plan over the validation
    rows. Of equally good ones the shortest stays.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=rounds, stepSize=step, maxDepth=depth, minInstancesPerNode=least, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    model = trees.fit(assembler.transform(class_weight(train, label)))
    precision = prefix_precision(model, assembler.transform(validation), label)
    best = max(sorted(precision), key=lambda k: precision[k]) if precision else len(model.treeWeights)
    return PipelineModel(stages=[assembler, first_trees(model, best)])


def first_trees(model: GBTClassificationModel, k: int) -> GBTClassificationModel:
    """The ensemble of a model's first k trees."""
    if k >= len(model.treeWeights):
        return model
    jvm, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    kept = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, k)
    weights = gateway.new_array(gateway.jvm.double, k)
    for i in range(k):
        kept[i], weights[i] = jvm.trees()[i], float(model.treeWeights[i])
    cut = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(jvm.uid(), kept, weights, jvm.numFeatures())
    return GBTClassificationModel(jvm.copyValues(cut, jvm.extractParamMap()) if hasattr(jvm, "copyValues") else cut)


def prefix_precision(model: GBTClassificationModel, rows: DataFrame, label: str) -> dict[int, float]:
    """Average precision on rows of the first k trees, for every k."""
    names, out = [], rows.select("features", F.col(label).alias("y"))
    for i, tree in enumerate(model.trees):
        names.append(f"__t{i}")
        out = tree.copy({tree.predictionCol: names[-1]}).transform(out)
    steps = F.array(*[F.col(n) * float(w) for n, w in zip(names, model.treeWeights)])
    zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    sums = F.aggregate(steps, zero, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["all"], a["sum"] + x).alias("all")), lambda a: a["all"])
    long = out.select("y", F.posexplode(sums).alias("k", "s"))
    blocks = ranking.tied_blocks(long, "s", "y", by=["k"])
    return {r["k"] + 1: r["ap"] or 0.0 for r in blocks.groupBy("k").agg(ranking.average_precision().alias("ap")).collect()}


def margin(predicted: DataFrame, model: PipelineModel) -> Column:
    """Log-odds: twice the raw prediction of boosted trees, the raw prediction itself otherwise."""
    raw = vector_to_array("rawPrediction")[1]
    return raw * 2.0 if hasattr(model.stages[-1], "treeWeights") else raw


def calibrate(scored: DataFrame, margin_col: str, label: str) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * margin + b) is the probability; (1, 0) with one class only."""
    if scored.select(label).distinct().count() < 2:
        return 1.0, 0.0
    rows = VectorAssembler(inputCols=[margin_col], outputCol="__m").transform(scored)
    fit = LogisticRegression(featuresCol="__m", labelCol=label, regParam=0.0, standardization=False).fit(rows)
    return float(fit.coefficients[0]), float(fit.intercept)


def probability(margin_: Column, platt: tuple[float, float]) -> Column:
    return sigmoid(margin_ * platt[0] + platt[1])


def top_contributions(values: Column, k: int = 3) -> Column:
    """The k largest by size of an array of contributions, as (idx, value rounded to 3 places); those of nothing are left out."""
    pairs = F.transform(values, lambda v, i: F.struct((-F.abs(v)).alias("order"), i.alias("idx"), v.alias("value")))
    best = F.slice(F.array_sort(F.filter(pairs, lambda p: p["order"] < -1e-9)), 1, k)
    return F.transform(best, lambda p: F.struct(p["idx"].cast("int").alias("idx"), half_up(p["value"], 3).alias("value")))


def linear_contributions(model: PipelineModel) -> Column:
    """Coefficient times standardised value for each feature of a predicted row."""
    coefs = F.array(*[F.lit(float(c)) for c in model.stages[-1].coefficients])
    return F.zip_with(vector_to_array("features"), coefs, lambda x, c: x * c)


def importance(model: PipelineModel, features: Sequence[str], k: int = 15) -> list[tuple[str, float]]:
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else [abs(c) for c in last.coefficients]
    return sorted(zip(features, (float(v) for v in values)), key=lambda x: (-x[1], x[0]))[:k]


def cross_fit(df: DataFrame, fold: str, folds: int, fit, score) -> DataFrame:
    """Every row scored by a model of the other folds' rows: fit(train) -> model, score(model, rows) -> rows."""
    out = None
    for k in range(folds):
        held = score(fit(df.where(F.col(fold) != k)), df.where(F.col(fold) == k))
        out = held if out is None else out.unionByName(held)
    return out

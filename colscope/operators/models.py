"""Chart-type and axis-role classifiers on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit, TrainValidationSplitModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .evaluate import rank_metrics, top_k

# Size of the tree models.
TREES, DEPTH, LEARNING_RATE, LAYERS = 100, 2, 0.1, [128, 64]


def _pipeline(features: Sequence[str], label: str, classifier) -> Pipeline:
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    index = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep")
    return Pipeline(stages=[assemble, index, classifier])


Model = PipelineModel | boosting.BoostedModel


def train_type_model(train: DataFrame, features: Sequence[str], label: str = "trace_type",
                     trees: int = TREES, depth: int = DEPTH, seed: int = 100) -> PipelineModel:
    """Chart-type classifier over many classes (a forest of shallow trees)."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return _pipeline(features, label, forest).fit(train)


def train_boosted_type_model(train: DataFrame, features: Sequence[str], label: str = "trace_type",
                             trees: int = TREES, depth: int = DEPTH, seed: int = 100) -> boosting.BoostedModel:
    """Chart-type classifier: boosted trees over all classes at once (see ``boosting.fit``)."""
    return boosting.fit(train, features, label, trees, depth=depth, rate=LEARNING_RATE, seed=seed)


def train_axis_model(train: DataFrame, features: Sequence[str], label: str = "is_x_or_y",
                     trees: int = TREES, depth: int = DEPTH, seed: int = 100) -> boosting.BoostedModel:
    """Axis-role classifier: boosted trees, two classes."""
    return boosting.fit(train, features, label, trees, depth=depth, rate=LEARNING_RATE, seed=seed)


def train_network(train: DataFrame, features: Sequence[str], classes: int, label: str = "trace_type",
                  hidden: Sequence[int] = tuple(LAYERS), iterations: int = 100, seed: int = 42) -> PipelineModel:
    """Fully connected network classifier."""
    net = MultilayerPerceptronClassifier(layers=[len(features), *hidden, classes], maxIter=iterations, seed=seed)
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    index = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error")
    return Pipeline(stages=[assemble, index, net]).fit(train)


def class_labels(model: Model) -> list[str]:
    """Class names by index, as numbered in training."""
    return list(model.labels if isinstance(model, boosting.BoostedModel) else model.stages[1].labels)


def score(model: Model, df: DataFrame) -> DataFrame:
    """Rows with ``probability`` as an array and the true class number when known."""
    out = model.transform(df)
    if isinstance(model, boosting.BoostedModel):
        return out
    return out.withColumn("probability", vector_to_array("probability"))


def predict(model: Model, df: DataFrame, k: int = 2) -> DataFrame:
    """Best types with probabilities; numbers outside the mapping give ``unknown``."""
    labels = F.array(*[F.lit(x) for x in class_labels(model)])
    return top_k(score(model, df), "probability", labels, k)


def evaluate_model(model: Model, test: DataFrame) -> DataFrame:
    return rank_metrics(score(model, test), "probability", "label")


def importances(spark: SparkSession, model: Model, features: Sequence[str]) -> DataFrame:
    """Importance per input feature of a tree model (a boosted model's share of the total gain)."""
    weights = model.importances() if isinstance(model, boosting.BoostedModel) else model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(w)) for f, w in zip(features, weights)],
                                 "feature string, importance double")


def top_importances(imp: DataFrame, n: int = 5) -> DataFrame:
    return imp.orderBy(F.desc("importance"), "feature").limit(n)


def value_range(start: float, end: float, step: float) -> list[float]:
    """Parameter values from ``start`` up to, not including, ``end``."""
    count = max(0, math.ceil((end - start) / step - 1e-9))
    return [start + i * step for i in range(count)]


def parameter_search(train: DataFrame, features: Sequence[str], label: str, param: str, values: Sequence,
                     seed: int = 100, parallelism: int = 4, trees: int = TREES) -> TrainValidationSplitModel:
    """Forests for each value of one parameter, fitted in parallel and kept as sub-models.

    The driver holds as many models as there are values: ``trees`` shallow trees each.
    """
    forest = RandomForestClassifier(numTrees=trees, maxDepth=DEPTH, seed=seed)
    pipe = _pipeline(features, label, forest)
    grid = ParamGridBuilder().addGrid(forest.getParam(param), list(values)).build()
    return TrainValidationSplit(
        estimator=pipe, estimatorParamMaps=grid, trainRatio=0.8, seed=seed, parallelism=parallelism,
        collectSubModels=True,
        evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")).fit(train)


def search_table(searched: TrainValidationSplitModel, values: Sequence, test: DataFrame) -> DataFrame:
    """Accuracy, hit@1, hit@2 and mean rank on ``test`` for each parameter value; ``test`` is best a stored table."""
    out = None
    for value, model in zip(values, searched.subModels):
        row = evaluate_model(model, test).select(F.lit(float(value)).alias("param"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def best_parameter(table: DataFrame) -> DataFrame:
    return table.agg(F.max_by("param", "acc").alias("param"), F.max("acc").alias("acc"))

"""One fit over many machines with the boosted trees of pyspark.ml, for feature tables beyond what one task holds."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import selection
from driftline.sources.workspace import shared_folder


def spark_params(params: dict) -> dict:
    """The nearest parameters of pyspark.ml's trees to those of the boosting kernel."""
    columns = params.get("tree_columns", 1.0) * params.get("level_columns", 1.0) * params.get("node_columns", 1.0)
    return {"maxIter": int(params["trees"]), "stepSize": float(params["rate"]), "maxDepth": int(params["depth"]), "subsamplingRate": float(params.get("rows", 1.0)),
            "featureSubsetStrategy": f"{columns:.4f}" if columns < 1 else "all", "minInstancesPerNode": int(max(1, params.get("child_rows", 1), 4 * params.get("child_weight", 0.0)))}


def classifier(params: dict, seed: int) -> GBTClassifier:
    return GBTClassifier(featuresCol="vector", labelCol="label", seed=seed, **{"maxBins": 64, **params})


def fit(rows: DataFrame, columns: list[str], params: dict, seed: int) -> PipelineModel:
    context = rows.sparkSession.sparkContext
    if params.get("maxIter", 0) > 100 and not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(rows.sparkSession))  # long boosting cuts its lineage there
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="vector", handleInvalid="keep"), classifier(params, seed)]).fit(rows)


def stop_at(losses: list[float], patience: int) -> tuple[int, bool]:
    """The number of trees with the least loss before patience trees brought no gain, and whether so many came."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def cut(model: GBTClassificationModel, trees: int) -> GBTClassificationModel:
    """The model of the first trees only."""
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    ml, all_trees, all_weights = gateway.jvm.org.apache.spark.ml, java.trees(), java.treeWeights()
    first, weights = gateway.new_array(ml.regression.DecisionTreeRegressionModel, trees), gateway.new_array(gateway.jvm.double, trees)
    for i in range(trees):
        first[i], weights[i] = all_trees[i], all_weights[i]
    made = ml.classification.GBTClassificationModel(java.uid(), first, weights, java.numFeatures(), java.numClasses())
    return GBTClassificationModel(made).setFeaturesCol(model.getFeaturesCol())


def fit_stopped(train: DataFrame, held: DataFrame, columns: list[str], params: dict, seed: int, patience: int) -> tuple[PipelineModel, int]:
    """Boosting that ends when patience trees bring no gain on held, cut at its best; and its number of trees.

    Spark's own validation ends at the first tree without a gain. A longer run with the same seed begins
    with the trees of a shorter one, so runs are doubled until one holds the end: twice the trees at most.
    """
    most, n = params["maxIter"], 2 * patience
    while True:
        model = fit(train, columns, params | {"maxIter": min(n, most)}, seed)
        best, ended = stop_at(model.stages[1].evaluateEachIteration(model.stages[0].transform(held)), patience)
        if ended or n >= most:
            return PipelineModel([model.stages[0], cut(model.stages[1], best)]), best
        n *= 2




def select(rows: DataFrame, columns: list[str], top: int | None, least_auc: float) -> list[str]:
    """The best columns by the univariate AUC of these rows; all if top is None."""
    if top is None:
        return columns
    scored = selection.univariate_auc(rows.select("id", *columns), rows.select("id", "label"), columns)
    return selection.selected(scored, top, least_auc) or columns


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("id", vector_to_array("probability")[1].alias("p"))

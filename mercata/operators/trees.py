"""Boosted trees: training that stops by a later-dated part, and the fitted ensemble as one column expression."""

from __future__ import annotations

import json
import uuid

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NODES = "struct<roots:array<int>,depth:int,nodes:array<struct<f:int,t:double,l:int,r:int,v:double>>>"


def dealt(rows: DataFrame, task_rows: int = 100_000, few: int = 4) -> DataFrame:
    """``rows`` over as many partitions as their number asks for, dealt and sorted by their content; those in ``few`` partitions or less stay as they lie, if that is enough.

    Boosting runs two stages for each level of each tree, so on few rows the fixed cost of tasks rules. ``rows`` are counted, so pass a kept table.
    """
    wanted, now = -(-rows.count() // task_rows), rows.rdd.getNumPartitions()
    if wanted <= now <= few:
        return rows
    key = F.xxhash64(*rows.columns)
    return rows.repartition(max(1, wanted), key).sortWithinPartitions(key)


def fit_boosted(
    rows: DataFrame, features: str = "features", label: str = "label", held_back: str | None = "held_back", trees: int = 500, depth: int = 10, rate: float = 0.05,
    leaf_rows: int = 100, row_share: float = 0.8, column_share: float = 0.8, tolerance: float = 1e-4, seed: int = 42,
):
    """Boosted regression trees on ``rows``; where the boolean column ``held_back`` is given, rounds end by the error of its rows, which are not learned from.

    Rounds end when the error falls by less than ``tolerance`` of itself, and the rounds up to the best are kept: ``getNumTrees`` of the model tells how
    many of ``trees``. The residuals' lineage is cut every ten rounds in the folder of ``spark.checkpoint.dir``.
    """
    boosted = GBTRegressor(
        featuresCol=features, labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=leaf_rows, subsamplingRate=row_share,
        featureSubsetStrategy=str(column_share), validationTol=tolerance, checkpointInterval=10, seed=seed, cacheNodeIds=False, maxMemoryInMB=512,
    )
    return (boosted.setValidationIndicatorCol(held_back) if held_back else boosted).fit(rows)


def ensemble_json(spark: SparkSession, model, folder: str) -> str:
    """The nodes of a fitted ensemble as JSON of ``NODES``, read from the files that the model writes of itself below ``folder``.

    Nodes of all trees stand in one array; a leaf has l = -1 and its value times its tree's weight. Its size is the model's, at most trees times 2^(depth + 1) nodes.
    """
    path = f"{folder}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    node = "nodeData"
    read = spark.read.parquet(f"{path}/data").select(
        "treeID", f"{node}.id", f"{node}.prediction", F.col(f"{node}.leftChild").alias("left"), F.col(f"{node}.rightChild").alias("right"),
        F.col(f"{node}.split.featureIndex").alias("feature"), F.get(f"{node}.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    held = read.orderBy("treeID", "id").toPandas()
    weights = model.treeWeights
    roots, nodes, base = [], [], 0
    for tree, own in held.groupby("treeID", sort=True):
        roots.append(base)
        for n in own.itertuples():
            leaf = n.left < 0
            nodes.append(
                {"f": -1, "t": 0.0, "l": -1, "r": -1, "v": n.prediction * weights[tree]} if leaf
                else {"f": int(n.feature), "t": n.threshold, "l": int(n.left) + base, "r": int(n.right) + base, "v": 0.0}
            )
        base += len(own)
    return json.dumps({"roots": roots, "depth": max(1, max(t.depth for t in model.trees)), "nodes": nodes})


def boosted_value(ensemble: str, features: Column) -> Column:
    """The ensemble's prediction for an array<double> of features in training order.

    The ensemble is parsed once, when the plan is optimized, and then a constant. Each tree is walked from its root, a fold over its depth, and the
    leaves are added up: one expression in the JVM, usable inside other folds.
    """
    model = F.from_json(F.lit(ensemble), NODES)
    nodes = model["nodes"]

    def walk(root: Column) -> Column:
        def down(at: Column, _: Column) -> Column:
            node = F.get(nodes, at)
            goes = F.when(F.get(features, node["f"]) <= node["t"], node["l"]).otherwise(node["r"])
            return F.when(node["l"] < 0, at).otherwise(goes)

        return F.aggregate(F.sequence(F.lit(1), model["depth"]), root, down)

    return F.aggregate(model["roots"], F.lit(0.0), lambda total, root: total + F.get(nodes, walk(root))["v"])

"""Model heads on pyspark.ml: linear head, tree head, non-negative fusion, grouped folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import lit


def linear_head(train: DataFrame, features: str, label: str = "y", weight: str = "weight", c: float = 0.05) -> PipelineModel:
    """Scaled logistic regression with sample weights; the penalty follows 1 / (c * sum of weights)."""
    total = train.agg(F.sum(weight)).first()[0]
    scaler = StandardScaler(inputCol=features, outputCol="_scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, LogisticRegression(featuresCol="_scaled", labelCol=label, weightCol=weight, regParam=1 / (c * total), standardization=False, maxIter=200)]).fit(train)


#: Size of the tree head. Trees grow level by level, so 31 leaves are five levels.
TREES = {"maxIter": 400, "stepSize": 0.04, "maxDepth": 5, "minInstancesPerNode": 40, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.7"}


def layer_shares(model: PipelineModel, df: DataFrame, features: str, layers: int) -> DataFrame:
    """``df`` with ``layer_contributions``: what each of ``layers`` equal runs of features adds to the linear head's log-odds."""
    scaler, lr = model.stages
    coef, mean, std = (F.array(*(lit(float(v)) for v in x)) for x in (lr.coefficients.toArray(), scaler.mean.toArray(), scaler.std.toArray()))
    x = vector_to_array(features)
    part = F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.when(std[i] > 0, coef[i] * (x[i] - mean[i]) / std[i]).otherwise(lit(0)))
    width = (F.size(x) / layers).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.lit(layers - 1)), lambda k: F.aggregate(F.slice("_part", k * width + 1, width), lit(0), lambda s, v: s + v))
    return df.withColumn("_part", part).select(*df.columns, each.alias("layer_contributions"))


def tree_head(train: DataFrame, features: str, label: str = "y", weight: str = "weight", names: Sequence[str] | None = None, exclude: Sequence[str] = (), **size: object) -> PipelineModel:
    """Boosted trees over a vector column, of the size TREES unless said otherwise. With ``names`` of its numbers, those in ``exclude`` are
    never looked at."""
    width = train.select(vector_to_array(features).alias("v")).select(F.size("v")).first()[0]
    used = [i for i in range(width) if names is None or names[i] not in exclude]
    trees = GBTClassifier(featuresCol="_used", labelCol=label, weightCol=weight, seed=0, **(TREES | size))
    return Pipeline(stages=[VectorSlicer(inputCol=features, outputCol="_used", indices=used), trees]).fit(train)


def tree_nodes(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(tree, node, feature, threshold, left, right, value) of a tree head, features by their place in the whole vector; a
    leaf has no children. The sum of the values of the leaves that a clip ends in is its log-odds."""
    slicer, trees = model.stages
    used, rows = slicer.getIndices(), []
    for t, (tree, weight) in enumerate(zip(trees.trees, trees.treeWeights, strict=True)):
        todo = [(0, tree._call_java("rootNode"))]
        n = 1
        while todo:
            i, node = todo.pop()
            value = 2.0 * weight * node.prediction()
            if node.subtreeDepth() == 0:
                rows.append((t, i, None, None, None, None, value))
                continue
            split = node.split()
            rows.append((t, i, used[split.featureIndex()], split.threshold(), n, n + 1, value))
            todo += [(n, node.leftChild()), (n + 1, node.rightChild())]
            n += 2
    return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, value double")


def tree_contributions(clips: DataFrame, clip: str, features: str, nodes: DataFrame, depth: int) -> DataFrame:
    """(clip, base, contributions map<feature, value>): what each feature adds to the log-odds of the trees.

    A clip walks down every tree; at each step the change of the node's value counts for the feature that decided it. ``base``
    is the sum of the roots' values; it and the contributions add up to the log-odds. The nodes, as many as the model has,
    go to all tasks; one row for each clip and tree walks ``depth`` levels without a shuffle.
    """
    node = F.broadcast(nodes.select("tree", "node", "feature", "threshold", "left", "right", "value"))
    roots = nodes.filter("node = 0").select("tree", F.col("value").alias("now"))
    base = roots.agg(F.sum("now").alias("base"))
    at = clips.select(F.col(clip).alias("clip"), vector_to_array(features).alias("x")).join(F.broadcast(roots), how="cross").withColumns({"node": F.lit(0), "steps": F.array().cast("array<struct<feature:int,value:double>>")})
    for _ in range(depth):
        here = at.join(node.drop("value"), ["tree", "node"])
        goes = F.when(F.col("feature").isNull(), F.col("node")).when(F.col("x")[F.col("feature")] <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        here = here.select("clip", "x", "tree", "now", "steps", "feature", goes.alias("node")).join(node.select("tree", "node", "value"), ["tree", "node"])
        step = F.struct("feature", (F.col("value") - F.col("now")).alias("value"))
        at = here.select("clip", "x", "tree", "node", F.col("value").alias("now"), F.when(F.col("feature").isNull(), F.col("steps")).otherwise(F.array_append("steps", step)).alias("steps"))
    parts = at.select("clip", F.explode("steps").alias("s")).groupBy("clip", "s.feature").agg(F.sum("s.value").alias("value"))
    sums = parts.groupBy("clip").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("contributions"))
    out = clips.select(F.col(clip).alias("clip")).join(sums, "clip", "left").join(F.broadcast(base), how="cross")
    return out.select("clip", "base", F.coalesce("contributions", F.create_map().cast("map<int,double>")).alias("contributions"))


def nonneg_fusion(logits: DataFrame, columns: list[str], label: str = "y", weight: str = "weight", penalty: float = 1e-3):
    """Logistic regression over head log-odds with coefficients of at least 0."""
    rows = VectorAssembler(inputCols=columns, outputCol="_logits").transform(logits)
    lr = LogisticRegression(featuresCol="_logits", labelCol=label, weightCol=weight, regParam=2 * penalty, standardization=False, maxIter=200)
    lr.setLowerBoundsOnCoefficients(DenseMatrix(1, len(columns), [0.0] * len(columns)))
    return lr.fit(rows)


def log_odds(model, df: DataFrame, name: str) -> DataFrame:
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("rawPrediction")[1]).select(*df.columns, name)


def grouped_folds(df: DataFrame, group: str, y: str, count: int = 5) -> DataFrame:
    """``df`` with ``fold``: groups are dealt in the order of a digest, class by class, so that repeated sources stay together.

    ValueError if a class has fewer than two groups. Only one row for each group is ordered, and
    its rank comes from ranges of the digest, not from one sorted task.
    """
    from tessera.operators.running import running_sums

    groups = df.groupBy(group).agg(F.max(y).alias("_y"))
    sizes = {r["_y"]: r["n"] for r in groups.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1} or min(sizes.values()) < 2:
        raise ValueError("folds need at least two groups of each class")
    k = min(count, *sizes.values())
    digest = F.conv(F.substring(F.md5(F.col(group).cast("string").cast("binary")), 1, 12), 16, 10).cast("double")
    keyed = groups.withColumn("_key", digest + F.col("_y") * lit(2.0**50)).withColumn("_one", F.lit(1))
    ranked = running_sums(keyed, "_key", [F.col(group)], {"_rank": "_one"})
    return df.join(ranked.select(group, F.pmod("_rank", F.lit(k)).alias("fold")), group)


def dense(column: str):
    """An array column as a vector, on the JVM."""
    return array_to_vector(F.transform(F.col(column), lambda v: v.cast("double")))

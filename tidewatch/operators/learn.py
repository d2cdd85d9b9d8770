"""Training and scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import evaluate, prepare
from tidewatch.schemas import CATEGORICAL

# Widths of the hidden layers, and what batch normalization adds to a variance.
HIDDEN = (128, 64, 32)
BATCH_NORM_EPS = 1e-5


def weighted(df: DataFrame, pos_weight: float, label: str = "binary_label") -> DataFrame:
    """Add ``weight``: ``pos_weight`` for positives, 1 for negatives."""
    return df.withColumn("weight", F.when(F.col(label) == 1, float(pos_weight)).otherwise(1.0))


def train_classifier(
    train: DataFrame,
    features: str = "features",
    label: str = "binary_label",
    pos_weight: float | None = None,
    algorithm: str = "logistic",
    partitions: int | None = None,
    validation: str | None = None,
    **params,
) -> Model:
    """Fit a binary classifier on an ML vector column, positives weighted by negatives/positives.

    ``partitions`` spreads the rows before the first pass, for inputs with fewer files than cores.
    ``validation`` (boosted trees only) names a boolean column: rows where it is true are not learned
    from, and boosting stops once their loss no longer falls by ``validationTol`` of what it is.
    """
    seen = train if validation is None else train.filter(~F.col(validation))
    if pos_weight is None:
        pos_weight = evaluate.class_weight(seen, label).first()["pos_weight"]
    if pos_weight is None:
        raise ValueError("no positive rows to learn from")
    kinds = {"logistic": LogisticRegression, "gbt": GBTClassifier}
    kept = [features, label]
    if validation is not None:
        kept.append(validation)
        params["validationIndicatorCol"] = validation
    learner = kinds[algorithm](
        featuresCol=features, labelCol=label, weightCol="weight", **params
    )
    rows = weighted(train.select(*kept), pos_weight, label)
    return learner.fit(rows if partitions is None else rows.repartition(partitions))


def predict(model: Model, df: DataFrame) -> DataFrame:
    """Add the logit ``z`` and the probability ``p`` of the positive class."""
    scored = model.transform(df)
    raw = vector_to_array(F.col("rawPrediction"))[1]
    p = vector_to_array(F.col("probability"))[1]
    # Boosted trees put half the logit into their raw prediction.
    z = 2 * raw if type(model).__name__.startswith("GBT") else raw
    return scored.withColumns({"z": z, "p": p}).drop(
        "rawPrediction", "probability", "prediction"
    )


# --- history --------------------------------------------------------------------------------------


def training_history(spark: SparkSession, model: Model) -> DataFrame:
    """(epoch, train_loss) of a fitted logistic model: its objective from before the first step on."""
    losses = model.summary.objectiveHistory
    rows = [(i, float(x)) for i, x in enumerate(losses)]
    return spark.createDataFrame(rows, "epoch int, train_loss double")


def epoch_history(
    model: GBTClassificationModel,
    rows: DataFrame,
    held: str,
    pos_weight: float,
    features: str = "features",
    label: str = "binary_label",
) -> DataFrame:
    """(epoch, train_loss, val_loss, train_f1, val_f1) of boosted trees: a row per tree, with the trees up to it.

    ``held`` names a boolean column, true for validation rows. Losses are means of the cross entropy with positives
    weighted; F1 takes a probability of one half or more as positive, and is 0 without any positive, told or
    true. A side without rows has null figures. One pass: each tree is applied once per row, a batch's logits are running
    sums over its trees, and a task returns one row per epoch and side.
    """
    columns = [f"_tree_{i}" for i in range(len(model.trees))]
    scored = rows.select(F.col(label).cast("int").alias("y"), F.col(held).alias("held"), F.col(features).alias("_features"))
    for tree, column in zip(model.trees, columns):
        scored = tree.setFeaturesCol("_features").setPredictionCol(column).transform(scored)
    weights = np.asarray(model.treeWeights) * 2  # boosted trees add up to half the logit
    count = len(columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, count, 5))
        for batch in batches:
            y, side = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            z = np.cumsum(batch.column(2).flatten().to_numpy().reshape(-1, count) * weights, axis=1)
            positive, told = (y == 1)[:, None], z >= 0
            loss = np.where(positive, pos_weight * np.logaddexp(0, -z), np.logaddexp(0, z))
            figures = (np.ones_like(z), loss, told & positive, told & ~positive, ~told & positive)
            for k in (0, 1):
                totals[k] += np.stack([f[side == k].sum(axis=0) for f in figures], axis=1)
        for k in (0, 1):
            yield pa.RecordBatch.from_pydict({
                "epoch": pa.array(range(1, count + 1), pa.int32()), "held": pa.array([k == 1] * count),
                **dict(zip(("n", "loss", "tp", "fp", "fn"), totals[k].T))})

    parts = scored.select("y", "held", F.array(*columns)).mapInArrow(
        sums, "epoch int, held boolean, n double, loss double, tp double, fp double, fn double")

    def figures(side: str, chosen: Column) -> list[Column]:
        n, loss, tp, fp, fn = (F.sum(F.when(chosen, F.col(c))) for c in ("n", "loss", "tp", "fp", "fn"))
        f1 = F.when(tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
        return [F.when(n > 0, loss / n).alias(f"{side}_loss"), F.when(n > 0, f1).alias(f"{side}_f1")]

    every = [*figures("train", ~F.col("held")), *figures("val", F.col("held"))]
    return parts.groupBy("epoch").agg(*every).select("epoch", "train_loss", "val_loss", "train_f1", "val_f1")


# --- serving --------------------------------------------------------------------------------------


def encode_packets(
    features: DataFrame,
    scaler: prepare.Scaler,
    output: str = "vector",
    compat: bool = False,
) -> DataFrame:
    """Add the model input of each packet as an array in the scaler's order.

    Inputs a packet cannot give are 0 before scaling. ``compat`` also takes all category columns as
    0, which is what encoding one packet at a time without its first category amounts to.
    """
    present, values = set(features.columns), []
    for feature, mean, std in zip(scaler.features, scaler.means, scaler.stds):
        column = next((c for c in CATEGORICAL if feature.startswith(f"{c}_")), None)
        if feature in present and feature not in CATEGORICAL:
            value = F.col(feature).cast("double")
        elif column and column in present and not compat:
            value = F.col(column).eqNullSafe(feature[len(column) + 1 :]).cast("double")
        else:
            value = F.lit(0.0)
        values.append((value - F.lit(float(mean))) / F.lit(float(std)))
    return features.withColumn(output, F.array(*values))


@dataclass(frozen=True)
class DenseNetwork:
    """Weights of a network of dense layers, each hidden one followed by ReLU and normalization.

    ``layers`` has (weight[out, in], bias[out]) per dense layer; ``norms`` has (gamma, beta, mean,
    variance) per hidden layer.
    """

    layers: Sequence[tuple]
    norms: Sequence[tuple]


# What a parameter table calls the tensors of a layer.
NORM_TENSORS = ("gamma", "beta", "mean", "variance")
PARAMETER_SCHEMA = "layer int, kind string, tensor string, shape array<int>, values array<double>"


def network_rows(network: DenseNetwork) -> list[tuple]:
    """The parameter table of a network: (layer, kind, tensor, shape, values)."""
    named = [
        (i, "dense", name, t)
        for i, layer in enumerate(network.layers) for name, t in zip(("weight", "bias"), layer)
    ] + [
        (i, "norm", name, t)
        for i, norm in enumerate(network.norms) for name, t in zip(NORM_TENSORS, norm)
    ]
    return [
        (i, kind, name, list(np.shape(t)), np.ravel(t).astype(float).tolist())
        for i, kind, name, t in named
    ]


def network_of(params: DataFrame) -> DenseNetwork:
    """Read a parameter table back; its size is that of the network."""
    found = {
        (r["layer"], r["kind"], r["tensor"]): np.array(r["values"]).reshape(r["shape"])
        for r in params.collect()
    }
    dense = sorted({i for i, kind, _ in found if kind == "dense"})
    norms = sorted({i for i, kind, _ in found if kind == "norm"})
    return DenseNetwork(
        [(found[i, "dense", "weight"], found[i, "dense", "bias"]) for i in dense],
        [tuple(found[i, "norm", t] for t in NORM_TENSORS) for i in norms],
    )


def score_dense_network(
    df: DataFrame, network: DenseNetwork, features: str = "vector", output: str = "score"
) -> DataFrame:
    """Add the logit of each row; null for a null vector or one without a finite result.

    One matrix product per Arrow batch, no shuffle. The network counts as non-deterministic, so that
    Spark runs it once per row and keeps filters on the logit above it.
    """
    hidden = list(zip(network.layers, network.norms))
    last_weight, last_bias = network.layers[-1]
    width, eps = network.layers[0][0].shape[1], BATCH_NORM_EPS

    @F.arrow_udf(T.DoubleType())
    def logits(batch: pa.Array) -> pa.Array:
        known = np.asarray(batch.is_valid())
        x = batch.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = x.reshape(-1, width)
        for (weight, bias), (gamma, beta, mean, variance) in hidden:
            x = np.maximum(x @ weight.T + bias, 0.0)
            x = (x - mean) / np.sqrt(variance + eps) * gamma + beta
        out = np.full(len(batch), np.nan)
        out[known] = (x @ last_weight.T + last_bias)[:, 0]
        return pa.array(out, mask=np.isnan(out))

    return df.withColumn(output, logits.asNondeterministic()(F.col(features)))

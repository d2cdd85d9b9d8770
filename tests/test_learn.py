import math
import random

import numpy as np
import pytest
from packet_rows import packet, udp
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.operators import evaluate, learn, packets, prepare
from tidewatch.plans import detection
from tidewatch.sources import params


@pytest.fixture(scope="module")
def separable(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        y = int(rng.random() < 0.25)
        rows.append(([rng.gauss(2 * y, 1), rng.gauss(-y, 1)], y, "holdout" if i % 10 == 0 else "train"))
    return spark.createDataFrame(rows, "features array<double>, binary_label int, split string")


def auc_of(df):
    return evaluate.auc(df, "p", "binary_label").first()[0]


@pytest.mark.parametrize("algorithm", ["logistic", "gbt"])
def test_classifiers(separable, algorithm):
    df = separable.withColumn("features", array_to_vector("features"))
    params = {"maxIter": 5} if algorithm == "gbt" else {}
    model = learn.train_classifier(df, algorithm=algorithm, **params)
    scored = learn.predict(model, df)
    assert auc_of(scored) > 0.9
    row = scored.agg(F.max(F.abs(F.col("p") - 1 / (1 + F.exp(-F.col("z")))))).first()
    assert row[0] < 1e-9


def test_history_of_a_fitted_model(spark, separable):
    df = separable.withColumn("features", array_to_vector("features"))
    history = learn.training_history(spark, learn.train_classifier(df)).orderBy("epoch").collect()
    assert history[-1]["train_loss"] < history[0]["train_loss"]


@pytest.mark.parametrize("early", [False, True])
def test_epochs_of_boosted_trees(spark, separable, early):
    df = separable.withColumn("features", array_to_vector("features")).withColumn("held", F.col("split") == "holdout")
    if early:
        model = learn.train_classifier(df, algorithm="gbt", validation="held", maxIter=30, maxDepth=2, validationTol=0.01)
        assert 1 < len(model.trees) < 30
    else:
        model = learn.train_classifier(df.where("not held"), algorithm="gbt", maxIter=6, maxDepth=2)
    history = learn.epoch_history(model, df, "held", 2.5).orderBy("epoch").collect()
    assert [r["epoch"] for r in history] == list(range(1, len(model.trees) + 1))
    assert history[-1]["train_loss"] < history[0]["train_loss"]
    for side, part in (("train", df.where("not held")), ("val", df.where("held"))):  # the whole model, scored as such
        scored = learn.predict(model, part)
        assert history[-1][f"{side}_loss"] == pytest.approx(
            evaluate.weighted_log_loss(scored, 2.5, label="binary_label").first()[0], abs=1e-9)
        assert history[-1][f"{side}_f1"] == pytest.approx(evaluate.f1_at(scored, label="binary_label").first()[0])
    alone = learn.epoch_history(model, df.where("not held"), "held", 2.5).first()
    assert alone["val_loss"] is None and alone["val_f1"] is None and alone["train_loss"] is not None


@pytest.mark.parametrize("algorithm", ["logistic", "gbt"])
def test_stored_models(separable, tmp_path, algorithm):
    df = separable.withColumn("features", array_to_vector("features"))
    model = learn.train_classifier(df, algorithm=algorithm, **({"maxIter": 3} if algorithm == "gbt" else {}))
    path = str(tmp_path / "model")
    params.save_model(model, path)
    params.save_model(model, path)  # replaces
    sums = [learn.predict(m, df).agg(F.sum("z"), F.sum("p")).first() for m in (model, params.load_model(path))]
    assert tuple(sums[0]) == pytest.approx(tuple(sums[1]))


def test_positives_are_required(spark):
    df = spark.createDataFrame([([1.0], 0)], "features array<double>, binary_label int")
    with pytest.raises(ValueError):
        learn.train_classifier(df.withColumn("features", array_to_vector("features")))


def tiny():
    return learn.DenseNetwork(
        [(np.array([[1.0, -1.0], [2.0, 0.0]]), np.array([0.0, 1.0])),
         (np.array([[1.0, 1.0]]), np.array([0.5]))],
        [(np.array([1.0, 2.0]), np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.array([1.0, 4.0]))],
    )


def test_dense_network_by_hand(spark):
    df = spark.createDataFrame([([3.0, 1.0],), ([1.0, 3.0],)], "vector array<double>")
    got = [r["score"] for r in learn.score_dense_network(df, tiny()).collect()]

    def by_hand(a, b):
        h = [max(a - b, 0.0), max(2 * a + 1, 0.0)]
        n = [h[0] / math.sqrt(1 + 1e-5), (h[1] - 1) / math.sqrt(4 + 1e-5) * 2 + 1]
        return n[0] + n[1] + 0.5

    assert got == [pytest.approx(by_hand(3, 1)), pytest.approx(by_hand(1, 3))]


def test_dense_network_without_a_vector(spark):
    rows = [([3.0, 1.0],), (None,), ([float("nan"), 1.0],)]
    scored = learn.score_dense_network(spark.createDataFrame(rows, "vector array<double>"), tiny()).collect()
    assert [r["score"] is None for r in scored] == [False, True, True]


def test_the_network_runs_once_per_row(spark, capsys):
    df = spark.createDataFrame([([3.0, 1.0],)], "vector array<double>")
    packets.flag_anomalies(learn.score_dense_network(df, tiny()), 0.1).explain("extended")
    optimized = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("logits(") == 1


def test_encoding(make):
    scaler = prepare.Scaler(
        ["src_bytes", "hot", "flag_S", "service_http", "count"],
        [40.0, 1.0, 0.0, 0.5, 0.0], [2.0, 2.0, 1.0, 0.5, 1.0],
    )
    features = packets.packet_features(make([packet(), packet(), udp(ip_len=44)]))
    vectors = learn.encode_packets(features, scaler).orderBy("packet_id").collect()
    assert [r["vector"] for r in vectors] == [
        [0.0, -0.5, 1.0, 1.0, 1.0], [0.0, -0.5, 1.0, 1.0, 2.0], [2.0, -0.5, 0.0, -1.0, 1.0],
    ]
    compat = learn.encode_packets(features, scaler, compat=True).orderBy("packet_id").first()
    assert compat["vector"] == [0.0, -0.5, 0.0, -1.0, 1.0]


def test_scoring_packets_end_to_end(make):
    scaler = prepare.Scaler(["count", "flag_S"], [0.0, 0.0], [1.0, 1.0])
    traffic = make([packet(0), packet(301), udp(), packet(ip_version=6)]).drop("score")
    scored = detection.score_packets(traffic, scaler, tiny()).orderBy("packet_id").collect()
    assert len(scored) == 3
    assert scored[0]["score"] == scored[1]["score"]  # the connection was forgotten in between
    assert scored[2]["score"] != scored[0]["score"]

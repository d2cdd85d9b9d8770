import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scoring
from tidewatch.operators import evaluate
from tidewatch.plans import training


def scores(n=400, seed=1, levels=None):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = int(rng.random() < 0.3)
        p = min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2)))
        rows.append((round(p * levels) / levels if levels else p, y))
    return rows


@pytest.fixture
def make_scores(spark):
    return lambda rows: spark.createDataFrame(rows, "p double, y int")


def cells(rows, t):
    tp = sum(p >= t and y == 1 for p, y in rows)
    fp = sum(p >= t and y == 0 for p, y in rows)
    return sum(y == 0 for _, y in rows) - fp, fp, sum(y == 1 for _, y in rows) - tp, tp


def test_confusion_and_rates(make_scores):
    rows = [(0.9, 1), (0.5, 1), (0.4, 1), (0.6, 0), (0.1, 0)]
    row = evaluate.metrics(make_scores(rows), 0.5).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (1, 1, 1, 2)
    assert row["accuracy"] == pytest.approx(0.6)
    assert row["precision"] == row["recall"] == row["f1"] == pytest.approx(2 / 3)
    assert (row["fnr"], row["fpr"]) == (pytest.approx(1 / 3), 0.5)


def test_empty_denominators_give_zero(make_scores):
    row = evaluate.metrics(make_scores([(0.1, 0)]), 0.5).first()
    assert [row[c] for c in ("precision", "recall", "f1", "fnr", "fpr")] == [0.0] * 5
    row = evaluate.metrics(make_scores([(0.1, 0)]).filter("false"), 0.5).first()
    assert row["accuracy"] == 0.0 and row["tn"] == 0


def test_sweep_equals_one_pass_per_threshold(make_scores):
    rows = scores(levels=100) + [(float("nan"), 1), (0.0, 0), (1.0, 1)]
    sweep = evaluate.threshold_sweep(make_scores(rows)).orderBy("threshold").collect()
    assert [r["threshold"] for r in sweep] == evaluate.THRESHOLDS
    for r in sweep:
        known = (r["tn"], r["fp"], r["fn"], r["tp"])
        assert known == cells(rows, r["threshold"])
        assert sum(known) == len(rows)
    assert all(a["recall"] >= b["recall"] for a, b in zip(sweep, sweep[1:]))
    best = evaluate.best_threshold(evaluate.threshold_sweep(make_scores(rows))).first()
    top = max(r["f1"] for r in sweep)
    assert best["threshold"] == min(r["threshold"] for r in sweep if r["f1"] == top)


def test_sweep_with_other_thresholds(make_scores):
    rows = scores(50)
    sweep = evaluate.threshold_sweep(make_scores(rows), [0.7, -1.0, 2.0]).orderBy("threshold")
    got = [(r["threshold"], r["tn"], r["fp"], r["fn"], r["tp"]) for r in sweep.collect()]
    assert got == [(t, *cells(rows, t)) for t in (-1.0, 0.7, 2.0)]


def test_lowest_threshold_wins_ties(make_scores):
    evaluation = training.evaluate_scores(make_scores([(0.05, 0), (0.95, 1)]))
    assert evaluation.threshold == 0.1
    assert evaluation.report.first().asDict() == (
        {"tp": 1, "fp": 0, "tn": 1, "fn": 0, "fpr": 0.0, "fnr": 0.0}
    )


def walk(rows):
    """(score, tp, fp) from the highest score down."""
    points, tp, fp = [], 0, 0
    for s in sorted({p for p, _ in rows}, reverse=True):
        tp += sum(p == s and y == 1 for p, y in rows)
        fp += sum(p == s and y == 0 for p, y in rows)
        points.append((s, tp, fp))
    return points


@pytest.mark.parametrize("levels", [None, 20])
def test_curves(make_scores, levels):
    rows = scores(300, levels=levels)
    df = make_scores(rows).repartition(6)
    points = walk(rows)
    pos, neg = points[-1][1], points[-1][2]
    roc = evaluate.roc_curve(df, drop_intermediate=False).orderBy(F.desc("threshold")).collect()
    assert [(r["threshold"], r["fpr"], r["tpr"]) for r in roc] == (
        [(math.inf, 0.0, 0.0)] + [(s, fp / neg, tp / pos) for s, tp, fp in points]
    )
    steps = [(points[0][1], points[0][2])] + [
        (b[1] - a[1], b[2] - a[2]) for a, b in zip(points, points[1:])
    ]
    last = len(points) - 1
    kept = [p for i, p in enumerate(points) if i in (0, last) or steps[i] != steps[i + 1]]
    roc = evaluate.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert [r["threshold"] for r in roc] == [math.inf] + [p[0] for p in kept]
    xy = [(0, 0)] + [(fp / neg, tp / pos) for _, tp, fp in points]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(xy, xy[1:]))
    assert evaluate.auc(df).first()[0] == pytest.approx(area)
    pr = evaluate.pr_curve(df).orderBy(F.desc_nulls_last("threshold")).collect()
    assert [(r["precision"], r["recall"]) for r in pr] == (
        [(tp / (tp + fp), tp / pos) for _, tp, fp in points] + [(1.0, 0.0)]
    )
    recall = [0.0] + [tp / pos for _, tp, _ in points]
    ap = sum((b - a) * p[1] / (p[1] + p[2]) for a, b, p in zip(recall, recall[1:], points))
    assert evaluate.average_precision(df).first()[0] == pytest.approx(ap)


def test_auc_agrees_with_ml(make_scores):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = make_scores(scores(levels=50))
    judge = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0)
    assert evaluate.auc(df).first()[0] == pytest.approx(judge.evaluate(df))


def test_separable_scores(make_scores):
    df = make_scores([(0.9, 1), (0.8, 1), (0.2, 0)])
    assert evaluate.auc(df).first()[0] == 1.0
    assert evaluate.average_precision(df).first()[0] == 1.0


def test_curves_count_rows_without_a_score(spark):
    rows = [(0.9, 1), (0.8, 1), (0.3, 0), (0.2, 0), (None, 1), (float("nan"), 0)]
    df = spark.createDataFrame(rows, "p double, y int")
    counted = evaluate.cumulative_counts(df).agg(F.sum("pos"), F.sum("neg")).first()
    matrix = evaluate.confusion_matrix(df, 0.5).first()
    assert tuple(counted) == (matrix["tp"] + matrix["fn"], matrix["tn"] + matrix["fp"]) == (3, 3)
    roc = evaluate.roc_curve(df, drop_intermediate=False).orderBy(F.desc("threshold")).collect()
    assert [(r["fpr"], r["tpr"]) for r in roc][-2:] == [(2 / 3, 2 / 3), (1.0, 1.0)]
    assert evaluate.auc(df).first()[0] == pytest.approx(6.5 / 9)


def test_class_weight(make_scores):
    row = evaluate.class_weight(make_scores([(0.0, 0)] * 3 + [(0.0, 1)] * 2)).first()
    assert (row["negatives"], row["positives"], row["pos_weight"]) == (3, 2, 1.5)
    assert evaluate.class_weight(make_scores([(0.0, 0)])).first()["pos_weight"] is None


def test_loss_is_stable(spark):
    df = spark.createDataFrame([(1000.0, 0), (-1000.0, 1), (0.0, 1)], "z double, y int")
    loss = evaluate.weighted_log_loss(df, 3.0).first()["loss"]
    assert loss == pytest.approx((1000 + 3000 + 3 * math.log(2)) / 3)


def test_shapes_and_labels(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "label string")
    assert [tuple(r) for r in evaluate.label_distribution(df).collect()] == [("b", 2), ("a", 1)]
    shapes = evaluate.table_shape(train=df, test=df.limit(1)).collect()
    assert sorted(map(tuple, shapes)) == [("test", 1, 1), ("train", 3, 1)]


def test_splits_reached(spark):
    rows = [(x,) for x in (None, float("nan"), 0.0, 0.1, 0.15, 0.2, 9.0)]
    df = spark.createDataFrame(rows, "x double")
    got = [r[0] for r in df.select(scoring.splits_reached("x", [0.1, 0.2])).collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2]

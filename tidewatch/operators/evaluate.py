"""Evaluation of scores against labels.

Tables have a probability column ``p`` and a 0/1 column ``y`` unless other names are given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import scoring
from tidewatch.session import staged

# The thresholds 0.10, 0.11, ..., 0.90.
THRESHOLDS = [(10 + i) / 100 for i in range(81)]


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).count().orderBy(F.desc("count"), label)


def table_shape(**tables: DataFrame) -> DataFrame:
    """Rows and columns of each named table."""
    shapes = None
    for name, df in tables.items():
        shape = df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        shapes = shape if shapes is None else shapes.unionByName(shape)
    return shapes


def _ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def class_weight(df: DataFrame, label: str = "y") -> DataFrame:
    """Negatives per positive, the weight of a positive row; null without positives."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.count_if(F.col(label) == 1).alias("positives"),
    )
    weight = _ratio(F.col("negatives"), F.col("positives"), None)
    return counts.withColumn("pos_weight", weight)


def weighted_log_loss(
    df: DataFrame, pos_weight: float, logit: str = "z", label: str = "y"
) -> DataFrame:
    loss = scoring.weighted_loss(F.col(logit), F.col(label), pos_weight)
    return df.agg(F.avg(loss).alias("loss"))


def confusion_counts(hit: Column, label: str = "y") -> dict[str, Column]:
    positive = F.col(label) == 1
    hit = F.coalesce(hit, F.lit(False))
    return {
        "tn": F.count_if(~hit & ~positive),
        "fp": F.count_if(hit & ~positive),
        "fn": F.count_if(~hit & positive),
        "tp": F.count_if(hit & positive),
    }


def confusion_matrix(
    df: DataFrame, threshold: float | Column, score: str = "p", label: str = "y"
) -> DataFrame:
    hit = scoring.exceeds(F.col(score), threshold, "probability")
    return df.agg(*[c.alias(n) for n, c in confusion_counts(hit, label).items()])


def with_metrics(counts: DataFrame) -> DataFrame:
    """Rates from ``tn``, ``fp``, ``fn`` and ``tp``; an empty denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "accuracy": _ratio(tp + tn, tn + fp + fn + tp),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "fnr": _ratio(fn, fn + tp),
        "fpr": _ratio(fp, fp + tn),
    })


def metrics(df: DataFrame, threshold: float, score: str = "p", label: str = "y") -> DataFrame:
    return with_metrics(confusion_matrix(df, threshold, score, label))


def f1_at(df: DataFrame, threshold: float = 0.5, score: str = "p", label: str = "y") -> DataFrame:
    return metrics(df, threshold, score, label).select("f1")


def final_report(df: DataFrame, threshold: float, score: str = "p", label: str = "y") -> DataFrame:
    return report_of(metrics(df, threshold, score, label))


def report_of(rates: DataFrame) -> DataFrame:
    """The report of a row of ``with_metrics``, such as the best one of a sweep."""
    return rates.select("tp", "fp", "tn", "fn", "fpr", "fnr")


def threshold_sweep(
    df: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    score: str = "p",
    label: str = "y",
) -> DataFrame:
    """The metrics at every threshold from one pass over the rows.

    Rows are counted by how many thresholds they reach; running sums over these few counts then give
    the confusion counts of every threshold.
    """
    splits = sorted(thresholds)
    positive = F.col(label) == 1
    counts = df.groupBy(scoring.splits_reached(score, splits).alias("reached")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    # From here on there is one row per threshold and one for scores that reach none.
    levels = df.sparkSession.range(len(splits) + 1).select(
        F.col("id").cast("int").alias("reached"), F.lit(0).alias("pos"), F.lit(0).alias("neg")
    )
    order = Window.orderBy("reached")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    above = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    matrix = (
        counts.unionByName(levels)
        .groupBy("reached").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .select(
            F.get(scoring.doubles(splits), F.col("reached") - 1).alias("threshold"),
            F.sum("neg").over(below).alias("tn"),
            F.sum("neg").over(above).alias("fp"),
            F.sum("pos").over(below).alias("fn"),
            F.sum("pos").over(above).alias("tp"),
        )
        .filter(F.col("threshold").isNotNull())
    )
    return with_metrics(matrix)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the highest F1, the lowest of several."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


# --- curves ---------------------------------------------------------------------------------------


def cumulative_counts(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Per distinct score: ``pos`` and ``neg`` at it, ``tp`` and ``fp`` from it up, and the totals.

    Rows are pre-aggregated by score. The distinct scores are then range-partitioned and written out,
    which fixes the ranges; running sums run inside each range and start from the totals of the
    ranges above it, so no task holds more than one range. ``turn`` marks the highest score, the
    lowest one, and those whose next lower neighbour has other counts. Rows without a score (null or
    NaN) reach no threshold but the lowest of all, minus infinity; so every row counts, as in the
    confusion matrix.
    """
    positive = F.col(label) == 1
    given = F.col(score).cast("double")
    reached = F.when(given.isNull() | F.isnan(given), float("-inf")).otherwise(given)
    by_score = df.groupBy(reached.alias("threshold")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    ranges = staged(
        by_score.repartitionByRange(F.desc("threshold")).withColumn("_range", F.spark_partition_id())
    )
    # One row per range, at most as many as there are shuffle partitions.
    sums = ranges.groupBy("_range").agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.max_by(F.struct("pos", "neg"), "threshold").alias("head"),
    )
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    totals = sums.select(
        "_range",
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_fp"),
        F.sum("p").over(everything).alias("positives"),
        F.sum("n").over(everything).alias("negatives"),
        F.lead("head").over(Window.orderBy("_range")).alias("_below"),
    )
    inside = Window.partitionBy("_range").orderBy(F.desc("threshold"))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.coalesce(F.lead(F.struct("pos", "neg")).over(inside), F.col("_below"))
    tp = F.sum("pos").over(running) + F.col("_tp")
    fp = F.sum("neg").over(running) + F.col("_fp")
    highest = (tp == F.col("pos")) & (fp == F.col("neg"))
    return ranges.join(F.broadcast(totals), "_range").select(
        "threshold",
        "pos",
        "neg",
        tp.alias("tp"),
        fp.alias("fp"),
        "positives",
        "negatives",
        (highest | ~F.struct("pos", "neg").eqNullSafe(following)).alias("turn"),
    )


def roc_curve(
    df: DataFrame, score: str = "p", label: str = "y", drop_intermediate: bool = True
) -> DataFrame:
    """(threshold, fpr, tpr) from (inf, 0, 0) on. ``drop_intermediate`` leaves out points on a straight
    line between their neighbours; the area stays the same."""
    counts = cumulative_counts(df, score, label)
    points = counts.filter("turn") if drop_intermediate else counts
    curve = points.select(
        F.col("threshold").cast("double").alias("threshold"),
        _ratio(F.col("fp"), F.col("negatives"), None).alias("fpr"),
        _ratio(F.col("tp"), F.col("positives"), None).alias("tpr"),
    )
    return curve.unionByName(_origin(curve, threshold=float("inf"), fpr=0.0, tpr=0.0))


def _origin(curve: DataFrame, **values) -> DataFrame:
    """One row of fixed values with the schema of ``curve``."""
    one = curve.sparkSession.range(1)
    return one.select(
        *[F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in curve.schema]
    )


def auc(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Area under the ROC curve by trapezoids."""
    counts = cumulative_counts(df, score, label)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    sums = counts.agg(area.alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(_ratio(F.col("area"), F.col("p") * 1.0 * F.col("n"), None).alias("auc"))


def pr_curve(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """(threshold, precision, recall) per distinct score, closed by precision 1 at recall 0."""
    counts = cumulative_counts(df, score, label)
    curve = counts.select(
        F.col("threshold").cast("double").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _ratio(F.col("tp"), F.col("positives"), 1.0).alias("recall"),
    )
    return curve.unionByName(_origin(curve, threshold=None, precision=1.0, recall=0.0))


def average_precision(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Sum of precision times the step in recall."""
    counts = cumulative_counts(df, score, label)
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    sums = counts.agg(steps.alias("steps"), F.sum("pos").alias("p"))
    return sums.select(_ratio(F.col("steps"), F.col("p")).alias("average_precision"))

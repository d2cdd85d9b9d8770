"""Learned values as Parquet tables, so that training and detection can be separate jobs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators import learn, prepare

DEFAULT_THRESHOLD = 0.5


def save_scaler(spark: SparkSession, scaler: prepare.Scaler, path: str) -> None:
    rows = [
        (i, f, float(m), float(s))
        for i, (f, m, s) in enumerate(zip(scaler.features, scaler.means, scaler.stds))
    ]
    _save(spark.createDataFrame(rows, "pos int, feature string, mean double, std double"), path)


def load_scaler(spark: SparkSession, path: str) -> prepare.Scaler:
    return prepare.scaler_of(spark.read.parquet(path))


def save_vocabulary(spark: SparkSession, vocabulary: prepare.Vocabulary, path: str) -> None:
    rows = [(c, v) for c, values in vocabulary.categories.items() for v in values]
    _save(spark.createDataFrame(rows, "feature string, category string"), path)


def load_vocabulary(spark: SparkSession, path: str) -> prepare.Vocabulary:
    rows = spark.read.parquet(path).collect()
    features = sorted({r["feature"] for r in rows})
    return prepare.Vocabulary(
        {f: sorted(r["category"] for r in rows if r["feature"] == f) for f in features}
    )


def save_network(spark: SparkSession, network: learn.DenseNetwork, path: str) -> None:
    _save(spark.createDataFrame(learn.network_rows(network), learn.PARAMETER_SCHEMA), path)


def load_network(spark: SparkSession, path: str) -> learn.DenseNetwork:
    return learn.network_of(spark.read.parquet(path))


def save_model(model: Model, path: str) -> None:
    """A fitted classifier, in Spark ML's own format."""
    PipelineModel(stages=[model]).write().overwrite().save(path)


def load_model(path: str) -> Model:
    return PipelineModel.load(path).stages[0]


def save_threshold(spark: SparkSession, threshold: float, path: str) -> None:
    _save(spark.createDataFrame([(float(threshold),)], "threshold double"), path)


def load_threshold(spark: SparkSession, path: str) -> float:
    """The stored threshold, or 0.5 if there is none."""
    try:
        return spark.read.parquet(path).first()["threshold"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return DEFAULT_THRESHOLD


def _save(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").parquet(path)

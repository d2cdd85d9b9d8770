"""From labelled flows to a model, its evaluation and a threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import evaluate, learn, prepare
from tidewatch.schemas import CATEGORICAL, NUMERIC
from tidewatch.session import staged


@dataclass(frozen=True)
class Prepared:
    """``train`` has a ``split`` column; both tables have ``features`` and ``binary_label``."""

    train: DataFrame
    test: DataFrame
    vocabulary: prepare.Vocabulary
    scaler: prepare.Scaler


def prepare_flows(
    train: DataFrame,
    test: DataFrame,
    numeric=tuple(NUMERIC),
    categorical=tuple(CATEGORICAL),
    frac: float = 0.1,
    seed: int = 42,
    fit_on_all: bool = True,
) -> Prepared:
    """Labels, one-hot columns, cleaning, scaling and split.

    The scaler sees all of ``train`` including the rows held out from it afterwards; with
    ``fit_on_all=False`` the split comes first and held-out rows do not reach the scaler.
    """
    vocabulary = prepare.fit_vocabulary(train, test, columns=categorical)
    values = prepare.feature_values(numeric, vocabulary)
    names = list(values)

    labelled, tested = (prepare.binary_label(prepare.drop_columns(d)) for d in (train, test))
    key = [c for c in labelled.columns if c != "binary_label"]
    split = prepare.stratified_split(labelled, "binary_label", key, frac, seed)
    seen = split if fit_on_all else split.filter(F.col("split") == "train")
    inputs = seen.select(F.array(*values.values()).alias("features"))
    scaler = prepare.scaler_of(prepare.array_scaler_params(inputs, names))

    def vectors(flows: DataFrame, *kept: str) -> DataFrame:
        scaled = {f"_{i}": c for i, c in enumerate(scaler.scaled(values).values())}
        rows = flows.select(*kept, "binary_label", *[c.alias(n) for n, c in scaled.items()])
        return prepare.assemble(rows, list(scaled))

    return Prepared(vectors(split, "split"), vectors(tested), vocabulary, scaler)


@dataclass(frozen=True)
class PreparedSparse:
    """As ``Prepared``; ``places`` has the ``place`` of each category among all of them, its ``mean`` and ``std``."""

    train: DataFrame
    test: DataFrame
    places: DataFrame
    scaler: prepare.Scaler


def prepare_sparse(
    train: DataFrame,
    test: DataFrame,
    numeric=tuple(NUMERIC),
    categorical=tuple(CATEGORICAL),
    frac: float = 0.1,
    seed: int = 42,
    fit_on_all: bool = True,
) -> PreparedSparse:
    """``prepare_flows`` for any number of categories: ``features`` are sparse vectors, numbers first.

    Categories are divided by their deviation and not centred, which a fitted intercept makes up for
    (``prepare.uncentred_intercept`` for weights learned on centred columns). Numbers are centred. The driver gets
    one scaler row per number, and counts.
    """
    labelled, tested = (prepare.binary_label(prepare.drop_columns(d)) for d in (train, test))
    key = [c for c in labelled.columns if c != "binary_label"]
    split = prepare.stratified_split(labelled, "binary_label", key, frac, seed)
    seen = split if fit_on_all else split.filter(F.col("split") == "train")
    places = prepare.category_places(train, test, columns=categorical)
    places = prepare.category_scaler(seen, places, categorical)
    values = {c: prepare.cleaned(F.col(c)) for c in numeric}
    inputs = seen.select(F.array(*values.values()).alias("features"))
    scaler = prepare.scaler_of(prepare.array_scaler_params(inputs, list(numeric))) if numeric else prepare.Scaler([], [], [])
    numbers = {f"_{i}": c for i, c in enumerate(scaler.scaled(values).values())}
    texts = {f"_text_{i}": c for i, c in enumerate(categorical)}
    own = places.replace({c: n for n, c in texts.items()}, subset="feature") if texts else places

    def vectors(flows: DataFrame, *kept: str) -> DataFrame:
        rows = flows.select(
            *kept, "binary_label", *[c.alias(n) for n, c in numbers.items()],
            *[F.col(c).alias(n) for n, c in texts.items()])
        rows = prepare.category_vector(rows, own, list(texts), list(numbers), "features")
        return rows.select(*kept, "binary_label", "features")

    return PreparedSparse(vectors(split, "split"), vectors(tested), places, scaler)


@dataclass(frozen=True)
class Evaluation:
    sweep: DataFrame
    threshold: float
    report: DataFrame


def train_and_evaluate(
    prepared: Prepared, algorithm: str = "logistic", **params
) -> tuple[Model, DataFrame, Evaluation]:
    """The model, the scored test set, and its metrics at the best threshold."""
    train = prepared.train.filter(F.col("split") == "train")
    model = learn.train_classifier(train, algorithm=algorithm, **params)
    scored = learn.predict(model, prepared.test)
    return model, scored, evaluate_scores(scored, "p", "binary_label")


def evaluate_scores(scored: DataFrame, score: str = "p", label: str = "y") -> Evaluation:
    sweep = staged(evaluate.threshold_sweep(scored, score=score, label=label))
    best = evaluate.best_threshold(sweep)
    # The sweep's row has the counts already: the report needs no second pass over the scores.
    return Evaluation(sweep, best.first()["threshold"], evaluate.report_of(best))

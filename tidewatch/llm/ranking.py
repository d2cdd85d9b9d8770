"""Quality scores learned from preference pairs (Bradley-Terry).

Each document has a short vector of text features and a hidden worth w * x. A good document is
preferred to a bad one with probability sigmoid(w * (x_good - x_bad)); w is the logistic regression
without intercept on feature differences. The labels say which documents are good or bad, so every
pair of a good and a bad one is a preference; ``PARTNERS`` partners are drawn for each. The threshold
is a quantile of the labelled documents' worths: the one that separates them best. A document's score
is the probability that it is preferred to a document at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidewatch.llm.common import bounded_examples, free_name, held_out, numbered, slices, word_hashes
from tidewatch.llm.rules import covered
from tidewatch.session import staged

#: At most so many labelled documents of each label are learned from, those of lowest hashed id; None for all.
MAX_EXAMPLES: int | None = None
#: Documents of the other label that each example is compared with.
PARTNERS = 4

FEATURES = ["log_words", "word_length", "upper", "signs", "exclamations", "digits", "distinct", "again", "repeated",
            "lone_signs", "log_line", "other_letters"]
_SIGNS = "#*$%&|<>=_~^{}[]\\"
_SPACE = " \t\n\x0b\x0c\r"


def features_of(text: str) -> list[float]:
    """The values of ``FEATURES``; an empty text has zeros."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = max(1, len(text) - sum(map(text.count, _SPACE)))
    hashes = word_hashes.of(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    sign = int(counts[[ord(c) for c in _SIGNS]].sum())
    lone = words.count(b"|") + words.count(b"-") + words.count(b"*")
    return [
        math.log1p(n), chars / n, upper / max(1, upper + lower), sign / chars, int(counts[33]) / n, digits / chars,
        len(set(words)) / n, float(np.count_nonzero(hashes[1:] == hashes[:-1])) / n, covered(hashes, 5) / n,
        lone / n, math.log1p(n / (1 + int(counts[10]))), int(counts[128:].sum()) / chars,
    ]


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features of every whole text; a null text is an empty one."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features_of(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(compute, "doc_id long, x array<double>")


@F.pandas_udf(ArrayType(DoubleType()))
def features_column(text: pd.Series) -> pd.Series:
    """``FEATURES`` of a text column."""
    return text.fillna("").map(features_of)


@dataclass
class Ranking:
    """worth = sum of weight * (x - mean); score = sigmoid(worth - threshold)."""

    mean: list[float]
    weight: list[float]
    threshold: float

    def worth(self, x: Column) -> Column:
        pairs = F.zip_with(x, F.array(*[F.struct(F.lit(m).alias("m"), F.lit(w).alias("w"))
                                               for m, w in zip(self.mean, self.weight)]),
                           lambda value, c: (value - c["m"]) * c["w"])
        return F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)

    def score(self, x: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(self.threshold) - self.worth(x)))


def _best_quantile(worths: DataFrame, sizes: dict[int, int]) -> float:
    """The worth, among 1,001 quantiles of all worths, that leaves the fewest of both kinds on the wrong side.

    ``worths`` (label, worth) may have any size: two rows per quantile and two per step between them reach the driver.
    """
    place = np.linspace(0, 1, 1001) * (sum(sizes.values()) - 1)
    low, high = np.floor(place).astype(int), np.ceil(place).astype(int)
    ranked = numbered(worths, "rank", "worth")
    wanted = sorted({*low.tolist(), *high.tolist()})
    at = {r["rank"]: r["worth"] for r in ranked.where(F.col("rank").isin(wanted)).select("rank", "worth").collect()}
    below, above = (np.asarray([at[k] for k in ranks.tolist()]) for ranks in (low, high))
    grid = np.maximum.accumulate(below + (above - below) * (place - low))

    @F.pandas_udf("int")
    def reached(worth: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(grid, worth.to_numpy(), "right"))

    counts = np.zeros((2, len(grid) + 1))
    for r in ranked.groupBy("label", reached("worth").alias("reached")).agg(F.count("*").alias("n")).collect():
        counts[r["label"], r["reached"]] = r["n"]
    bad, good = counts.cumsum(axis=1)[:, :-1]
    wrong = good / sizes[1] + 1 - bad / sizes[0]
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float((grid[best[0]] + grid[best[-1]]) / 2)


def fit_ranking(examples: DataFrame, max_examples: int | None = None, partners: int = PARTNERS) -> Ranking:
    """Learn from ``examples`` (doc_id, x, label 0 or 1); null labels are left out.

    With ``max_examples`` at most so many of each label are used, those of lowest hashed id. Without examples of both
    kinds nothing can be preferred: all weights are zero and every score is one half.
    """
    marked = examples.where(F.col("label").isin(0, 1)).select("label", "doc_id", "x")
    if max_examples is not None:
        marked = bounded_examples(marked, max_examples)
    chosen = numbered(marked, "number", "label", F.xxhash64("doc_id"), "doc_id")
    sizes = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    width = len(FEATURES)
    if len(sizes) < 2 or max(sizes.values()) < 2:
        return Ranking([0.0] * width, [0.0] * width, 0.0)
    # numbers go on from the bad ones to the good ones
    chosen = chosen.select("label", (F.col("number") - F.col("label") * sizes[0]).alias("k"), "x")
    values = [F.col("x")[k] for k in range(width)]
    moments = chosen.agg(*[F.avg(v).alias(f"m{k}") for k, v in enumerate(values)],
                         *[F.stddev_pop(v).alias(f"s{k}") for k, v in enumerate(values)]).first()
    mean = [moments[f"m{k}"] for k in range(width)]
    scale = [moments[f"s{k}"] or 1.0 for k in range(width)]
    unit = F.array(*[(v - F.lit(m)) / F.lit(s) for v, m, s in zip(values, mean, scale)])
    good = chosen.where("label = 1").select("k", unit.alias("g"))
    bad = chosen.where("label = 0").select("k", unit.alias("b"))
    # each example of the larger kind meets `partners` of the smaller kind
    most, few = (good, bad) if sizes[1] >= sizes[0] else (bad, good)
    least = min(sizes.values())
    step = [1 + j * max(1, least // partners) for j in range(partners)]
    meets = F.explode(F.array(*[(F.col("k") * 7 + s) % least for s in step])).alias("partner")
    side = most.columns[1]
    pairs = most.select(side, "k", meets).join(few.withColumnRenamed("k", "partner"), "partner")
    gap = F.zip_with("g", "b", lambda a, b: a - b)
    # a preference and its mirror image are the same preference; both signs make two classes
    rows = pairs.select(F.when(F.col("k") % 2 == 0, 1.0).otherwise(0.0).alias("y"), gap.alias("gap"))
    rows = rows.select("y", array_to_vector(
        F.transform("gap", lambda d: F.when(F.col("y") == 1.0, d).otherwise(-d))).alias("v"))
    model = LogisticRegression(featuresCol="v", labelCol="y", fitIntercept=False, standardization=False,
                               regParam=1e-3, maxIter=100).fit(rows)
    weight = [w / s for w, s in zip(model.coefficients.toArray().tolist(), scale)]
    found = Ranking(mean, weight, 0.0)
    found.threshold = _best_quantile(chosen.select("label", found.worth(F.col("x")).alias("worth")), sizes)
    return found


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label of the rows that may be learned from, one per id (the lowest label)."""
    return (
        labels.where(~held_out() & F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).cast("int").alias("label"))
    )


def _learned(found: DataFrame, labels: DataFrame, column: str) -> Ranking:
    """A ranking learned from all of ``found`` (doc_id, x) that have labels which may be learned from."""
    examples = found.join(learnable(labels, column), "doc_id")
    return fit_ranking(examples.groupBy("doc_id", "label").agg(F.min("x").alias("x")), MAX_EXAMPLES)


def accepted(docs: DataFrame, labels: DataFrame, column: str = "quality", cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``cut``, with all their columns."""
    x = free_name(docs.columns, "x")
    found = staged(docs.withColumn(x, features_column(F.col("text").cast("string"))))
    ranking = _learned(found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(x).alias("x")), labels, column)
    return found.where(ranking.score(F.col(x)) >= cut).drop(x)


def quality_scores(docs: DataFrame, labels: DataFrame, column: str = "quality", cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Labels are learned only from rows that are not held out. Scores depend on the text alone; a null text
    is an empty one; a null id is never held out nor learned from; repeated rows are all scored; no rows give
    none. Other columns of ``docs`` are not read.
    """
    found = staged(text_features(docs))
    score = _learned(found, labels, column).score(F.col("x"))
    return found.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int"))

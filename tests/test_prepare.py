import hashlib
import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import prepare
from tidewatch.plans import training
from tidewatch.schemas import FLOW_SCHEMA, NUMERIC


def test_schema_has_38_numeric_inputs():
    assert len(FLOW_SCHEMA) == 43
    assert len(NUMERIC) == 38


def test_required_columns(spark):
    df = spark.range(1)
    assert prepare.require_columns(df, ["id"]) is df
    with pytest.raises(KeyError, match="label"):
        prepare.require_columns(df, ["id", "label"])


def test_binary_label_counts_null_as_attack(spark):
    df = spark.createDataFrame([("normal",), ("neptune",), (None,), ("Normal",)], "label string")
    assert [r["binary_label"] for r in prepare.binary_label(df).collect()] == [0, 1, 1, 1]


def test_vocabulary_is_the_sorted_union(spark):
    train = spark.createDataFrame([("tcp", "b"), ("udp", None)], "protocol_type string, flag string")
    test = spark.createDataFrame([("icmp", "a")], "protocol_type string, flag string")
    vocabulary = prepare.fit_vocabulary(train, test, columns=["protocol_type", "flag"])
    names = ["flag_a", "flag_b", "protocol_type_icmp", "protocol_type_tcp", "protocol_type_udp"]
    assert list(vocabulary.columns) == names
    hot = prepare.one_hot(train, vocabulary)
    assert hot.columns == names
    assert [tuple(r) for r in hot.collect()] == [(0, 1, 0, 1, 0), (0, 0, 0, 0, 1)]


def test_align_and_conform(spark):
    left, right = prepare.align_features(
        spark.createDataFrame([(1, 2)], "b int, a int"), spark.createDataFrame([(3, 4)], "c int, a int")
    )
    assert left.columns == right.columns == ["a", "b", "c"]
    assert tuple(left.first()) == (2, 1, 0) and tuple(right.first()) == (4, 0, 3)
    df = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int")
    assert prepare.missing_features(df, ["w", "y"]) == ["w"]
    assert prepare.extra_features(df, ["w", "y"]) == ["x", "z"]
    assert tuple(prepare.conform_to(df, ["y", "w"], keep=["z"]).first()) == (3, 2, 0)


def test_cleaning(spark):
    inf = float("inf")
    rows = [(1.5, 1), (None, None), (float("nan"), 2), (inf, 3), (-inf, 4)]
    cleaned = prepare.clean_numeric(spark.createDataFrame(rows, "x double, n int")).collect()
    assert [r["x"] for r in cleaned] == [1.5, 0.0, 0.0, prepare.FLOAT32_MAX, prepare.FLOAT32_MAX]
    assert [r["n"] for r in cleaned] == [1, 0, 2, 3, 4]


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (6.0, 7.0)], "x double, c double")
    scaler = prepare.fit_scaler(df, ["x", "c"])
    assert scaler.means == [3.0, 7.0]
    assert scaler.stds == [pytest.approx(math.sqrt(14 / 3)), 1.0]
    new = spark.createDataFrame([(3.0, 9.0, "k")], "x double, c double, k string")
    assert tuple(prepare.apply_scaler(new, scaler).first()) == (0.0, 2.0, "k")


def sizes(spark, counts, frac=0.1):
    rows = spark.createDataFrame(list(counts.items()), "y int, n long")
    return {r["y"]: r["held"] for r in prepare.holdout_sizes(rows, "y", frac).collect()}


def test_holdout_sizes(spark):
    assert sizes(spark, {0: 95, 1: 5}) == {0: 10, 1: 0}
    assert sizes(spark, {0: 90, 1: 11}) == {0: 10, 1: 1}
    assert sizes(spark, {0: 4}) == {0: 1}


def split_counts(split):
    return {(r["y"], r["split"]): r["count"] for r in split.groupBy("y", "split").count().collect()}


def test_split_is_exact_and_takes_the_smallest_hashes(spark):
    df = spark.range(1003).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    split = prepare.stratified_split(df, "y", ["id"])
    assert split.columns == ["id", "y", "split"]
    held = sizes(spark, {0: 859, 1: 144})
    assert split_counts(split) == {
        (0, "holdout"): held[0], (0, "train"): 859 - held[0],
        (1, "holdout"): held[1], (1, "train"): 144 - held[1],
    }
    again = prepare.stratified_split(df.repartition(5), "y", ["id"])
    ids = lambda d: {r["id"] for r in d.filter("split = 'holdout'").collect()}
    assert ids(split) == ids(again)
    assert ids(split) != ids(prepare.stratified_split(df, "y", ["id"], seed=1))
    place = lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()
    for y in (0, 1):
        own = sorted((i for i in range(1003) if (i % 7 == 0) == y), key=place)
        assert ids(split) & set(own) == set(own[: held[y]])


@pytest.mark.parametrize("seed", range(5))
def test_split_is_exact_when_records_repeat(spark, seed):
    # 3,500 of 4,000 attack rows are one record, in several files
    df = spark.range(0, 16_000, 1, 6).select(
        (F.col("id") % 4 == 0).cast("int").alias("y"),
        F.when((F.col("id") % 4 == 0) & (F.col("id") < 14_000), 0).otherwise(F.col("id")).alias("x"),
    )
    split = prepare.stratified_split(df, "y", ["x"], seed=seed)
    assert split_counts(split) == {
        (0, "holdout"): 1200, (0, "train"): 10_800, (1, "holdout"): 400, (1, "train"): 3600,
    }
    # rows other than those the limit falls on keep together
    sides = split.groupBy("y", "x").agg(F.count_distinct("split").alias("n")).where("n > 1")
    assert sides.count() <= 1


def test_split_with_null_labels_and_keys(spark):
    rows = [(None if i % 3 == 0 else "a", None if i % 2 else i) for i in range(90)]
    split = prepare.stratified_split(spark.createDataFrame(rows, "y string, x int"), "y", ["x"])
    assert split_counts(split) == {
        (None, "holdout"): 3, (None, "train"): 27, ("a", "holdout"): 6, ("a", "train"): 54,
    }


def test_many_categories(spark):
    df = spark.range(10_001).select(F.concat(F.lit("s"), "id").alias("service"), "id")
    vocabulary = prepare.fit_vocabulary(df, columns=["service"])
    assert len(vocabulary.categories["service"]) == 10_001
    hot = prepare.one_hot_vector(df.where("id < 3"), df, columns=["service"]).orderBy("id").collect()
    order = sorted(f"s{i}" for i in range(10_001))
    assert [(r["categories"].size, list(r["categories"].indices)) for r in hot] == (
        [(10_001, [order.index(f"s{i}")]) for i in range(3)]
    )
    none = prepare.one_hot_vector(df.select(F.lit(None).cast("string").alias("service")).limit(1), df, columns=["service"])
    assert list(none.first()["categories"].indices) == []


def test_scaler_of_null_and_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, 3.0)], "x double, y double")
    scaler = prepare.fit_scaler(df, ["x", "y"])
    assert (list(scaler.means), list(scaler.stds)) == ([2.0, 2.0], [1.0, 1.0])
    scaler = prepare.fit_scaler(df.limit(0), ["x", "y"])
    assert (list(scaler.means), list(scaler.stds)) == ([0.0, 0.0], [1.0, 1.0])


def test_split_of_nothing(spark):
    df = spark.createDataFrame([], "id long, y int")
    assert prepare.stratified_split(df, "y", ["id"]).count() == 0


def test_prepared_flows(spark):
    rows = [
        (float(i), ["tcp", "udp"][i % 2], "normal" if i % 3 else "smurf", i) for i in range(60)
    ]
    df = spark.createDataFrame(rows, "x double, protocol_type string, label string, difficulty_level int")
    prepared = training.prepare_flows(df, df.limit(5), ["x"], ["protocol_type"])
    assert list(prepared.scaler.features) == ["x", "protocol_type_tcp", "protocol_type_udp"]
    assert prepared.train.columns == ["split", "binary_label", "features"]
    assert prepared.test.count() == 5
    assert prepared.train.filter("split = 'holdout'").count() == 6
    total = prepared.train.agg(F.sum(vector_to_array("features")[0])).first()[0]
    assert total == pytest.approx(0, abs=1e-9)


def test_places_number_categories_over_all_columns(spark):
    df = spark.createDataFrame([("b", "x", 1), (None, "y", 2), ("a", "x", 3)], "p string, q string, n int")
    other = spark.createDataFrame([("c", None)], "p string, q string")
    places = {(r["feature"], r["category"]): r["place"]
              for r in prepare.category_places(df, other, columns=["p", "q"]).collect()}
    assert places == {("p", "a"): 0, ("p", "b"): 1, ("p", "c"): 2, ("q", "x"): 3, ("q", "y"): 4}
    hot = prepare.one_hot_vector(df, other, columns=["p", "q"]).orderBy("n").collect()
    assert [(r["categories"].size, r["categories"].indices.tolist()) for r in hot] == [(5, [1, 3]), (5, [4]), (5, [0, 3])]
    assert prepare.category_places(df.limit(0), columns=["p", "q"]).count() == 0
    empty = prepare.one_hot_vector(df.limit(0), columns=["p", "q"])
    assert empty.columns == ["p", "q", "n", "categories"] and empty.count() == 0
    assert prepare.one_hot_vector(df, columns=[]).first()["categories"].size == 0


def test_places_of_a_million_categories(spark):
    df = spark.range(1_000_000).select(F.format_string("s%07d", F.col("id")).alias("service"))
    places = prepare.category_places(df, columns=["service"])
    wrong = places.filter(F.substring("category", 2, 7).cast("long") != F.col("place"))
    assert (places.count(), wrong.count()) == (1_000_000, 0)


def test_sparse_scores_equal_those_of_centred_columns(spark):
    rows = [
        (float(i % 11), ["tcp", "udp", None, "icmp"][i * 7 % 4], f"s{i % 5}", "normal" if i % 3 else "smurf", i)
        for i in range(120)
    ]
    names = "x double, protocol_type string, service string, label string, difficulty_level int"
    df = spark.createDataFrame(rows, names)
    test = spark.createDataFrame([(3.0, "udp", "new", "smurf", 1), (None, "tcp", "s1", "normal", 2)], names)
    columns = ["protocol_type", "service"]
    dense = training.prepare_flows(df, test, ["x"], columns)
    sparse = training.prepare_sparse(df, test, ["x"], columns)
    assert sparse.train.columns == dense.train.columns
    order = list(dense.scaler.features)
    places = {r["place"]: r for r in sparse.places.collect()}
    named = {n: i + 1 for i, n in ((k, f"{r['feature']}_{r['category']}") for k, r in places.items())}
    assert sorted(named) == sorted(order[1:])
    for name, at in named.items():
        r, i = places[at - 1], order.index(name)
        assert (r["mean"], r["std"]) == (pytest.approx(dense.scaler.means[i]), pytest.approx(dense.scaler.stds[i]))
    weight = {n: math.sin(3 * i + 1) for i, n in enumerate(order)}
    weights = spark.createDataFrame([(named[n] - 1, weight[n]) for n in named], "place long, weight double")
    intercept = prepare.uncentred_intercept(sparse.places, weights, 0.25)
    for part in ("train", "test"):
        centred = sorted(
            0.25 + sum(weight[n] * v for n, v in zip(order, r["features"].toArray()))
            for r in getattr(dense, part).collect())
        kept = sorted(
            intercept + sum((weight["x"] if i == 0 else weight[next(n for n in named if named[n] == i)]) * v
                            for i, v in zip(r["features"].indices, r["features"].values))
            for r in getattr(sparse, part).collect())
        assert kept == pytest.approx(centred, abs=1e-9)
    assert max(len(r["features"].indices) for r in sparse.train.collect()) == 3

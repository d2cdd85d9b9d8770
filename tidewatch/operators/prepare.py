"""From labelled flow tables to model input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schemas import CATEGORICAL, DIFFICULTY, LABEL
from tidewatch.session import staged

# Fixed value: the largest 32-bit float, which stands for both infinities.
FLOAT32_MAX = 3.4028234663852886e38


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def drop_columns(df: DataFrame, columns: Sequence[str] = (DIFFICULTY,)) -> DataFrame:
    return df.drop(*columns)


def binary_label(df: DataFrame, label: str = LABEL, output: str = "binary_label") -> DataFrame:
    """0 for ``normal``, 1 for anything else, null included."""
    return df.withColumn(output, F.when(F.col(label).eqNullSafe("normal"), 0).otherwise(1))


# --- categories -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """Category values per column, in the order of their dummy columns."""

    categories: Mapping[str, Sequence[str]]

    @property
    def columns(self) -> dict[str, tuple[str, str]]:
        """Dummy column name to (column, value), sorted by name."""
        named = {f"{c}_{v}": (c, v) for c, values in self.categories.items() for v in values}
        return dict(sorted(named.items()))


def categories(dfs: Sequence[DataFrame], columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """The distinct (feature, category) pairs of all tables; null is no category."""
    if not columns:
        return dfs[0].sparkSession.createDataFrame([], "feature string, category string")
    pairs = None
    for df in dfs:
        part = _cells(df, columns)
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs.distinct()


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, category) of every row and column that has one."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("category")) for c in columns])
    return df.select(F.explode(cells).alias("cell")).select("cell.*").filter(F.col("category").isNotNull())


def category_places(*dfs: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """(feature, category, place): numbers from 0 on, column by column as given, categories sorted.

    The categories stay a table. They are range-partitioned and written out; each range numbers its own, and goes
    on from the sizes of the ranges before it. A column without values, or a table without rows, has no places.
    """
    if not columns:
        return categories(dfs, columns).withColumn("place", F.lit(0).cast("long"))
    which = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature"))
    ranged = categories(dfs, columns).withColumn("_column", which).repartitionByRange("_column", "category")
    found = staged(ranged.withColumn("_slice", F.spark_partition_id()))
    ahead = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, which is as many as there are shuffle partitions.
    before = found.groupBy("_slice").agg(F.count("*").alias("_n")).select(
        "_slice", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_slice").orderBy("_column", "category")) - 1
    placed = found.withColumn("_own", own).join(staged(before), "_slice")
    return staged(placed.select("feature", "category", (F.col("_before") + F.col("_own")).alias("place")))


def fit_vocabulary(*dfs: DataFrame, columns: Sequence[str] = CATEGORICAL) -> Vocabulary:
    """Learn the categories of the given tables together.

    They become columns, so they come to the driver, all of them. Columns with very many
    categories are better encoded as one sparse vector, by ``one_hot_vector``, or ``training.prepare_sparse``.
    """
    rows = categories(dfs, columns).collect()
    return Vocabulary(
        {c: sorted(r["category"] for r in rows if r["feature"] == c) for c in columns}
    )


def dummies(vocabulary: Vocabulary) -> dict[str, Column]:
    return {
        name: F.col(c).eqNullSafe(value).cast("int")
        for name, (c, value) in vocabulary.columns.items()
    }


def one_hot(df: DataFrame, vocabulary: Vocabulary, drop: bool = True) -> DataFrame:
    """Add a 0/1 column per category; null and unseen values give zeros everywhere."""
    gone = set(vocabulary.categories) if drop else set()
    kept = [F.col(c) for c in df.columns if c not in gone]
    return df.select(*kept, *[c.alias(n) for n, c in dummies(vocabulary).items()])


def one_hot_vector(
    df: DataFrame, *others: DataFrame, columns: Sequence[str] = CATEGORICAL, output: str = "categories"
) -> DataFrame:
    """Add one sparse vector with a place per category of ``df`` and ``others``, column by column.

    For any number of categories (vectors end at 2^31 places): a row has as many entries as there are columns, and
    the driver sees the number of categories only. Null has no category.
    """
    return category_vector(df, category_places(df, *others, columns=columns), columns, output=output)


def category_vector(
    df: DataFrame,
    places: DataFrame,
    columns: Sequence[str] = CATEGORICAL,
    numbers: Sequence[str] = (),
    output: str = "categories",
) -> DataFrame:
    """Add a sparse vector: ``numbers`` first, then a place per row of ``places`` (of ``category_places``).

    A category counts 1, or 1 / ``std`` if ``places`` has that column; null and unseen categories give zeros.
    ``places`` is joined by Spark's choice: by broadcast if it is small, else by category with skew splitting.
    """
    value = 1 / F.col("std") if "std" in places.columns else F.lit(1.0)
    found = df
    for i, c in enumerate(columns):
        cell = F.struct((F.col("place") + len(numbers)).cast("int").alias("place"), value.alias("value"))
        own = places.filter(F.col("feature") == c).select(
            F.col("category").alias(f"_category_{i}"), cell.alias(f"_cell_{i}"))
        found = found.join(own, F.col(c) == F.col(f"_category_{i}"), "left").drop(f"_category_{i}")
    cells = [
        F.when(F.col(n) != 0, F.struct(F.lit(i).alias("place"), F.col(n).cast("double").alias("value")))
        for i, n in enumerate(numbers)
    ]
    cells = F.array(*cells, *[F.col(f"_cell_{i}") for i in range(len(columns))])
    given = F.array_compact(cells.cast("array<struct<place: int, value: double>>"))
    # The fields as which a sparse vector is stored.
    stored = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(places.count() + len(numbers)).cast("int").alias("size"),
        F.transform(given, lambda x: x["place"]).alias("indices"),
        F.transform(given, lambda x: x["value"]).alias("values"),
    )
    kept = [f for f in df.schema if f.name != output]
    rows = found.select(*[F.col(f.name) for f in kept], stored.alias(output))
    return staged(rows, T.StructType([*kept, T.StructField(output, VectorUDT())]))


def align_features(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give both tables the sorted union of their columns, absent ones as 0."""
    union = sorted(set(left.columns) | set(right.columns))
    return conform_to(left, union), conform_to(right, union)


def missing_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    return [f for f in features if f not in df.columns]


def extra_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in features]


def feature_differences(
    left: DataFrame, right: DataFrame, columns: Sequence[str] = CATEGORICAL
) -> DataFrame:
    """(kind, feature): dummy columns ``missing`` from ``left`` but in ``right``, and ``extra`` ones."""
    named = [
        categories([df], columns).select(F.concat_ws("_", "feature", "category").alias("feature"))
        for df in (left, right)
    ]
    missing = named[1].join(named[0], "feature", "left_anti")
    extra = named[0].join(named[1], "feature", "left_anti")
    kinds = [d.select(F.lit(k).alias("kind"), "feature") for d, k in ((missing, "missing"), (extra, "extra"))]
    return kinds[0].unionByName(kinds[1])


def conform_to(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the given features in the given order: missing ones are 0, extra ones go."""
    present = set(df.columns)
    columns = [F.col(f) if f in present else F.lit(0).alias(f) for f in features]
    return df.select(*keep, *columns)


# --- numbers --------------------------------------------------------------------------------------


def cleaned(value: Column) -> Column:
    """Null and NaN become 0, both infinities the largest 32-bit float."""
    number = value.cast("double")
    finite = F.when(F.abs(number) == float("inf"), FLOAT32_MAX).otherwise(number)
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(finite)


def clean_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Clean floating-point columns; of whole numbers only null needs care."""
    changed = {}
    for field in df.schema:
        if columns is not None and field.name not in columns:
            continue
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            changed[field.name] = cleaned(F.col(field.name))
        elif isinstance(field.dataType, T.IntegralType):
            changed[field.name] = F.coalesce(F.col(field.name), F.lit(0))
    return df.withColumns(changed)


@dataclass(frozen=True)
class Scaler:
    """Mean and divisor per feature; their order is the model's input order."""

    features: Sequence[str]
    means: Sequence[float]
    stds: Sequence[float]

    def scaled(self, values: Mapping[str, Column]) -> dict[str, Column]:
        """The values of known features, scaled, in the scaler's order."""
        return {
            f: (values[f] - F.lit(float(m))) / F.lit(float(s))
            for f, m, s in zip(self.features, self.means, self.stds) if f in values
        }


def scaler_params(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(pos, feature, mean, std); null is left out, and a deviation of zero, or of nothing, becomes 1."""
    return _scaler_rows(df, [F.col(f).cast("double") for f in features], features)


def array_scaler_params(
    df: DataFrame, features: Sequence[str], column: str = "features"
) -> DataFrame:
    """The same from one array column."""
    return _scaler_rows(df, [F.col(column)[i] for i in range(len(features))], features)


def _scaler_rows(df: DataFrame, values: Sequence[Column], features: Sequence[str]) -> DataFrame:
    each = [
        F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.lit(f).alias("feature"))
        for v, f in zip(values, features)
    ]
    rows = df.agg(F.array(*each).alias("each")).select(F.posexplode("each").alias("pos", "f"))
    std = F.coalesce(F.col("f.std"), F.lit(0.0))
    return rows.select(
        "pos",
        F.col("f.feature").alias("feature"),
        F.coalesce(F.col("f.mean"), F.lit(0.0)).alias("mean"),
        F.when(std == 0, 1.0).otherwise(std).alias("std"),
    )


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    """The parameters on the driver: one row per feature, whatever the size of the table."""
    return scaler_of(scaler_params(df, features))


def scaler_of(params: DataFrame) -> Scaler:
    rows = sorted(params.collect(), key=lambda r: r["pos"])
    return Scaler(
        [r["feature"] for r in rows], [r["mean"] for r in rows], [r["std"] for r in rows]
    )


def category_scaler(df: DataFrame, places: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Add to ``places`` the ``mean`` and ``std`` of each category's 0/1 column over the rows of ``df``.

    A deviation of zero, or of nothing, becomes 1, as in ``scaler_params``. One aggregation, whatever the number of
    categories; the columns themselves are never made.
    """
    rows = df.count()
    if not columns or not rows:
        return places.withColumn("mean", F.lit(0.0)).withColumn("std", F.lit(1.0))
    held = _cells(df, columns).groupBy("feature", "category").agg(F.count("*").alias("_n"))
    mean = F.coalesce(F.col("_n"), F.lit(0)) / F.lit(rows)
    std = F.sqrt(F.col("mean") * (1 - F.col("mean")))
    found = places.join(held, ["feature", "category"], "left").withColumn("mean", mean).drop("_n")
    return staged(found.withColumn("std", F.when(std == 0, 1.0).otherwise(std)))


def uncentred_intercept(places: DataFrame, weights: DataFrame, intercept: float) -> float:
    """The intercept for vectors whose means were left in, given that for centred ones.

    ``weights`` has (place, weight). The sum of weight times (x - mean) / std is that of weight times x / std, less a
    number that is the same for every row; so zeros stay zeros, and the scores are those of centred columns.
    """
    shift = F.sum(F.col("weight") * F.col("mean") / F.col("std"))
    return intercept - (places.join(weights, "place").agg(shift).first()[0] or 0.0)


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Scale the columns the scaler knows and leave the rest."""
    names = df.columns
    scaled = scaler.scaled({c: F.col(c) for c in names})
    return df.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in names])


def feature_values(numeric: Sequence[str], vocabulary: Vocabulary) -> dict[str, Column]:
    """The model inputs of raw flows: cleaned numbers in the given order, then the dummies."""
    numbers = {c: cleaned(F.col(c)) for c in numeric}
    return {**numbers, **{n: c.cast("double") for n, c in dummies(vocabulary).items()}}


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Put the features into one ML vector column."""
    kept = [c for c in df.columns if c not in set(features)]
    values = F.array(*[F.col(f).cast("double") for f in features])
    return df.select(*kept, array_to_vector(values).alias(output))


# --- split ----------------------------------------------------------------------------------------


# Hexadecimal digits of a key's hash that are settled at a time.
_DIGITS = (4, 8, 32)
# Rows of a class that one task may sort; a prefix with fewer is settled by whole hashes at once.
_FEW = 1_000_000


def holdout_sizes(counts: DataFrame, label: str, frac: float) -> DataFrame:
    """Add ``held`` to the rows of each class (``n``): ceil(frac·n) in all, shares kept, largest
    remainders first, equal ones by label. One row per class goes through one task."""
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    counted = counts.withColumn("_all", F.ceil(F.lit(float(frac)) * total)).withColumn(
        "_exact", F.col("_all") * F.col("n") / total
    )
    floored = counted.withColumn("_low", F.floor("_exact"))
    first = Window.orderBy((F.col("_low") - F.col("_exact")), F.col(label).cast("string"))
    extra = F.row_number().over(first) <= F.col("_all") - F.sum("_low").over(every)
    held = F.col("_low") + extra.cast("long")
    return floored.withColumn("held", held).drop("_all", "_exact", "_low")


def key_text(key: Sequence[str], seed: int) -> Column:
    """Seed and key as one text, null as empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    return F.concat_ws("|", F.lit(str(seed)), *cells)


def stratified_split(
    df: DataFrame, label: str, key: Sequence[str], frac: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add ``split`` (``train`` or ``holdout``), class shares kept; sizes are exact.

    Per class, the rows with the smallest md5 of ``key_text`` are held out. Where the limit falls is
    found from counts per hash prefix, longer prefixes only inside the one before, so no class is
    sorted. Rows with equal keys are alike to the split. If the limit falls among them, the group is
    written out and as many as are missing are taken from its files one after another, each file
    numbered by itself; one record that is repeated a billion times is thus still split exactly.
    """
    place = F.md5(key_text(key, seed))
    hashed = df.withColumn("_place", place)
    cut = lambda n: F.substring("_place", 1, n)
    counts = staged(hashed.groupBy(F.col(label).alias("_label"), cut(_DIGITS[0]).alias("_cut"))
                    .agg(F.count("*").alias("n")))
    classes = counts.groupBy("_label").agg(F.sum("n").alias("n"))
    limits = staged(holdout_sizes(classes, "_label", frac).where("held > 0").select("_label", "held"))

    def edge(groups: DataFrame) -> DataFrame:
        """The group of each class in which the limit falls; ``left`` of its ``n`` rows are held out."""
        upto = F.sum("n").over(Window.partitionBy("_label").orderBy("_cut"))
        found = groups.withColumn("left", F.col("held") - upto + F.col("n"))
        return staged(found.where((F.col("left") > 0) & (F.col("left") <= F.col("n"))))

    def of(rows: DataFrame, edges: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(edges.withColumnRenamed("_label", "_class"),
                         F.col("_label").eqNullSafe(F.col("_class")), how).drop("_class")

    edges = edge(of(counts, limits))
    inside = hashed.select(F.col(label).alias("_label"), "_place")
    before = _DIGITS[0]
    for digits in _DIGITS[1:]:
        if digits < _DIGITS[-1] and (edges.agg(F.max("n")).first()[0] or 0) <= _FEW:
            continue
        marks = edges.select("_label", F.col("left").alias("held"), F.col("_cut").alias("_prefix"))
        inside = staged(of(inside.drop("held", "_prefix"), marks).where(cut(before) == F.col("_prefix")))
        groups = inside.groupBy("_label", "held", cut(digits).alias("_cut")).agg(F.count("*").alias("n"))
        edges, before = edge(groups), digits
    ends = edges.select("_label", F.col("_cut").alias("_end"), "left", (F.col("left") < F.col("n")).alias("_cuts"))
    marked = of(hashed.withColumn("_label", F.col(label)), ends, "left")
    in_group = F.coalesce(F.col("_cuts") & (F.col("_place") == F.col("_end")), F.lit(False))
    names = [*df.columns, "split"]
    sides = lambda held: F.when(held, "holdout").otherwise("train")
    whole = marked.withColumn("split", sides(F.col("_place") <= F.col("_end")))
    if ends.where("_cuts").isEmpty():
        return whole.select(*names)
    group = staged(marked.where(in_group).withColumns({
        "_file": F.spark_partition_id(), "_row": F.monotonically_increasing_id(),
    }))
    sizes = group.groupBy("_label", "_file").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_label").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_label").alias("_class"), F.col("_file").alias("_part"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"),
    )
    same = F.col("_label").eqNullSafe(F.col("_class")) & (F.col("_file") == F.col("_part"))
    number = F.row_number().over(Window.partitionBy("_label", "_file").orderBy("_row"))
    chosen = group.withColumn("_number", number).join(starts, same)
    chosen = chosen.withColumn("split", sides(F.col("_start") + F.col("_number") <= F.col("left")))
    return whole.where(~in_group).select(*names).unionByName(chosen.select(*names))

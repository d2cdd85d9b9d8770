"""Running totals that stay balanced when one key holds a large share of all rows.

A window over a key sorts all rows of that key in one task. Rows of keys above ``max_rows`` are instead
range-partitioned by key and order and written out; each partition is summed on its own and the totals
of the partitions before it are added. A partition holds about ``max_rows`` rows whatever their
distribution, and a key has one total per partition. Nothing is sampled or dropped: this only decides
which task does the work.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import staged

# Rows of one key that a single task may sort.
MAX_GROUP_ROWS = 4_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """The keys with more rows than one task should hold, with their number of ``rows``.

    Exact, and pre-aggregated before the shuffle. At most one row per ``max_rows`` rows of ``df``.
    """
    counted = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    return staged(counted.where(F.col("rows") > max_rows))


def split_hot(
    df: DataFrame, keys: Sequence[str], hot: DataFrame
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of other keys, and of ``hot`` ones (None if there are none); no key column may be null here."""
    if hot.isEmpty():
        return df, None
    named = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    return df.join(named, same, "left_anti"), df.join(named, same, "left_semi")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column],
    max_rows: int = MAX_GROUP_ROWS,
    order: Sequence[str] = ("ts", "packet_id"),
    restart: Column | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add running sums per key in the given order.

    ``restart`` marks rows at which the sums start again at zero, not counting the row itself. Without hot
    keys this is one window over one shuffle. ``hot`` gives known hot keys and skips the search for them.
    """
    if hot is None:
        hot = hot_keys(df, keys, max_rows)
    cold, rest = split_hot(df, keys, hot)
    found = _summed(cold, keys, sums, order, restart)
    if rest is None:
        return found
    slices = max(2, -(-hot.agg(F.sum("rows")).first()[0] // max_rows))
    ranged = staged(
        rest.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    return found.unionByName(_sliced(ranged, keys, sums, order, restart))


def _at_restart(name: str, restart: Column | None) -> Column:
    return F.when(F.lit(False) if restart is None else restart, F.col(name))


def _summed(df, keys, sums, order, restart) -> DataFrame:
    running = (
        Window.partitionBy(*keys).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = df.withColumns({name: F.sum(value).over(running) for name, value in sums.items()})
    if restart is None:
        return found
    # Sums never fall, so the last restart has the largest of their values there.
    bases = {n: F.coalesce(F.max(_at_restart(n, restart)).over(running), F.lit(0)) for n in sums}
    return found.withColumns({n: F.col(n) - base for n, base in bases.items()})


def _sliced(df, keys, sums, order, restart) -> DataFrame:
    """The same from rows in ``_slice`` s that follow each other in the order."""
    running = (
        Window.partitionBy("_slice", *keys).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = df.withColumns({name: F.sum(value).over(running) for name, value in sums.items()})
    marks = {f"_mark_{n}": F.max(_at_restart(n, restart)).over(running) for n in sums}
    if restart is not None:
        found = found.withColumns(marks)
    values = [F.sum(value).alias(f"_sum_{name}") for name, value in sums.items()]
    totals = df.groupBy("_slice", *keys).agg(*values)
    ahead = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per key and slice: as many as there are tasks, and one more per key.
    before = totals.select(
        "_slice", *keys, *[F.coalesce(F.sum(f"_sum_{n}").over(ahead), F.lit(0)).alias(f"_before_{n}") for n in sums]
    )
    if restart is not None:
        last = found.groupBy("_slice", *keys).agg(*[F.max(f"_mark_{n}").alias(f"_last_{n}") for n in sums])
        joined = _joined(before, last, ["_slice", *keys])
        carried = {
            f"_carried_{n}": F.coalesce(F.max(F.col(f"_before_{n}") + F.col(f"_last_{n}")).over(ahead), F.lit(0))
            for n in sums
        }
        before = joined.withColumns(carried).drop(*[f"_last_{n}" for n in sums])
    found = _joined(found, staged(before), ["_slice", *keys])
    for n in sums:
        total = F.col(n) + F.col(f"_before_{n}")
        if restart is not None:
            mark = F.col(f"_before_{n}") + F.col(f"_mark_{n}")
            total = total - F.coalesce(mark, F.col(f"_carried_{n}"))
        found = found.withColumn(n, total)
    extra = [f"_{what}_{n}" for n in sums for what in ("before", "mark", "carried")]
    return found.drop("_slice", *extra)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join in which null equals null."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, same).drop(*[f"_right_{k}" for k in keys])

"""Running values within long groups, so that no task holds a whole group.

A plain window sends each group to one task, however long it is. Where a group is longer than a
task should be, the rows are sorted into ranges of (group, order), which cut it into pieces; every
piece is worked through by itself, and what the earlier pieces of its group amount to is carried into
it. Only one row for each group and range is needed for that, and a group has at most as many of
them as there are ranges. Where no group is so long, all of them are windows. Values are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a group that one task may work through.
LONG = 1_000_000
#: Of each kind: the value of a frame, the value of a whole piece, and how a carried value meets one.
_ADD = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
KINDS = {
    "sum": (F.sum, lambda c, o: F.sum(c), _ADD),
    "max": (F.max, lambda c, o: F.max(c), F.greatest),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c, o: F.max_by(c, F.when(F.col(c).isNotNull(), o)), lambda carried, own: F.coalesce(own, carried)),
    "next": (lambda c: F.last(c, ignorenulls=True), lambda c, o: F.min_by(c, F.when(F.col(c).isNotNull(), o)), lambda carried, own: F.coalesce(own, carried)),
}


def in_ranges(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows in order, with ``__part``, the number of their range. Ranges are even, also within one group."""
    return cut(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)).withColumn("__part", F.spark_partition_id())


def _so_far(kind: str, column: str, by: list[str], order: list[str], others: bool) -> Column:
    """The value of a window up to this row, or for ``next`` up to it from the end: both grow row by row."""
    keys = [F.col(c).desc() for c in order] if kind == "next" else order
    w = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1 if others else 0)
    return KINDS[kind][0](column).over(w)


def running(rows: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], others: bool = False) -> DataFrame:
    """Adds running values: ``{name: (kind, value)}`` with a kind of :data:`KINDS`.

    ``sum``, ``max`` and ``last`` (the last value that isn't null) are over the rows of the group up
    to this one, ``next`` (the first that isn't null) from this one on; with ``others`` this row itself
    is left out. A sum of nothing is 0, other kinds of nothing are null. Null groups are groups;
    rows of equal order stand in any order.
    """
    tmp = {name: f"__v_{name}" for name in values}
    given = cut(rows.select("*", *[v.alias(tmp[n]) for n, (_, v) in values.items()]))
    if given.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > LONG).isEmpty():
        alone = given.select(*rows.columns, *[_so_far(k, tmp[n], by, order, others).alias(n) for n, (k, _) in values.items()])
        return alone.withColumns({n: F.coalesce(n, F.lit(0)) for n, (k, _) in values.items() if k == "sum"})
    laid = in_ranges(given, by, order)
    place = F.struct(*order)
    whole = laid.groupBy(*by, "__part").agg(*[KINDS[k][1](tmp[n], place).alias(tmp[n]) for n, (k, _) in values.items()])
    carried = whole.select(  # of each group a row for each range at most
        *[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"),
        *[_so_far(k, tmp[n], by, ["__part"], True).alias(f"__c_{n}") for n, (k, _) in values.items()],
    )
    within = laid.select("*", *[_so_far(k, tmp[n], [*by, "__part"], order, others).alias(f"__w_{n}") for n, (k, _) in values.items()])
    on = [F.col("__part") == F.col("__p"), *[F.col(c).eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate(by)]]
    joined = within.join(carried, on)
    return joined.select(*rows.columns, *[KINDS[k][2](F.col(f"__c_{n}"), F.col(f"__w_{n}")).alias(n) for n, (k, _) in values.items()])


def numbered(rows: DataFrame, order: list[str], name: str = "at") -> DataFrame:
    """Adds ``name``, the place of each row in the order of all rows, from 0.

    Only the number of rows of each range reaches the driver.
    """
    laid = in_ranges(rows, [], order).withColumn("__local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["__part"]: r["n"] for r in laid.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, begins = 0, []
    for p in sorted(sizes):
        begins.append((p, before))
        before += sizes[p]
    begins = F.broadcast(rows.sparkSession.createDataFrame(begins, "__part int, __begin bigint"))  # one row a range
    return laid.join(begins, "__part").withColumn(name, F.col("__begin") + F.col("__local")).drop("__part", "__begin", "__local")


def values_at(rows: DataFrame, column: str, shares: tuple[float, ...]) -> list:
    """The values at rank ``int(share * (n - 1))`` of the values in ascending order; null where there are no rows."""
    n = rows.count()
    places = [int(q * (n - 1)) for q in shares]
    found = {r["at"]: r[column] for r in numbered(rows.select(column), [column]).where(F.col("at").isin(places)).collect()} if n else {}
    return [found.get(p) for p in places]

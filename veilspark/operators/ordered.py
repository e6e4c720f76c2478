"""Running sums and positions in a global order without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Parts that a table is cut into by the order's first value; each is ordered in a task of its own.
PARTS = 256


def part_of(rows: DataFrame, value: Column) -> Column:
    """Part of a numeric value: rows of lower parts come before. The cuts are approximate quantiles, PARTS at most; null is part -1."""
    shares = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    cuts = sorted(set(rows.agg(F.percentile_approx(value.cast("double"), shares, 10 * PARTS)).first()[0] or []))

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value <= F.lit(cuts[mid]), among(low, mid)).otherwise(among(mid + 1, high))

    return F.when(value.isNull(), F.lit(-1)).otherwise(among(0, len(cuts)))


def running(rows: DataFrame, part: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each name of ``sums``, the sum over the rows before: those of lower parts, and those before in its part.

    ``part`` must not decrease along ``order``. Rows that are equal in the order come in any order. The parts' totals, at
    most PARTS rows and two, are summed in one task; a part's rows in another.
    """
    cut = rows.withColumn("__part", part)
    totals = cut.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    lower = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__part", *[F.coalesce(F.sum(f"__{n}").over(lower), F.lit(0)).alias(f"__{n}") for n in sums])
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()])
    both = own.join(F.broadcast(base), "__part")
    return both.select(*[c for c in rows.columns if c not in sums], *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def hashed_part(value: Column) -> Column:
    """Part of a hexadecimal hash: its first two digits."""
    return F.conv(F.substring(value, 1, 2), 16, 10).cast("int")

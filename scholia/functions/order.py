"""Numbers for rows by an order that doesn't hang on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Adds the row's number, from 0, in the ascending order of the columns `order` (nulls
    first), which should tell rows apart; those it doesn't are numbered in any order.

    Rows are dealt to ranges between a few of the keys themselves, those with the
    least hashes; the driver gets these keys and a count a range, and ranks are taken
    within ranges. So neither a task nor the driver holds all rows, and the numbers
    are the same however the table is cut.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*order).dropna()
    few = keys.orderBy(F.xxhash64(*order), *order).limit(4 * ranges).distinct().orderBy(*order).collect()
    kinds = dict(df.dtypes)
    bound = lambda row: F.struct(*[F.lit(row[c]).cast(kinds[c]).alias(c) for c in order])
    own = F.struct(*[F.col(c) for c in order])
    step = max(1, int(len(few) ** 0.5))
    parts = [few[i : i + step] for i in range(0, len(few), step)]
    if parts:
        # Two levels, so that a row is compared with some 2 * sqrt(n) keys.
        tops, table = F.array(*[bound(p[-1]) for p in parts]), F.array(*[F.array(*[bound(r) for r in p]) for p in parts])
        coarse = F.size(F.filter(tops, lambda b: b < own))
        inner = F.size(F.filter(F.get(table, F.least(coarse, F.lit(len(parts) - 1))), lambda b: b < own))
        place = F.least(coarse * step + inner, F.lit(len(few)))
    else:
        place = F.lit(0)
    dealt = df.withColumn("_range", place)
    counts = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    before, total = [], 0
    for i in range(len(few) + 1):
        before.append(total)
        total += counts.get(i, 0)
    offset = F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_range"))
    by = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return dealt.withColumn(name, offset + F.row_number().over(by) - 1).drop("_range")

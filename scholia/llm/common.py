"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and all run on one machine, as in tests, a folder under
    /tmp/checkpoints; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return root or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends
    there, and what a later stage reads survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def range_bounds(df: DataFrame, column: str, groups: int) -> list[int]:
    """Ascending distinct upper bounds that cut the rows into about `groups` ranges
    of like size; the last is the maximum. Empty for a table without values.

    The driver gets `groups` numbers, whatever the table's size.
    """
    cuts = [i / groups for i in range(1, groups + 1)]
    row = df.agg(F.percentile_approx(column, cuts, 10 * groups).alias("b"), F.max(column).alias("m")).first()
    if row is None or row.m is None:
        return []
    return sorted({int(b) for b in row.b} | {int(row.m)})


def range_of(column: Column, bounds: list[int]) -> Column:
    """The number of bounds below the value: its range, with each bound the
    largest value of its range. Two levels, so the cost is about 2 * sqrt(n)
    comparisons. Nulls go to range 0."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if len(parts) == 1:
        return F.coalesce(F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < column)), F.lit(0))
    tops = F.array(*[F.lit(p[-1]).cast("long") for p in parts])
    table = F.array(*[F.array(*[F.lit(b).cast("long") for b in p]) for p in parts])
    coarse = F.size(F.filter(tops, lambda b: b < column))
    fine = F.size(F.filter(F.get(table, F.least(coarse, F.lit(len(parts) - 1))), lambda b: b < column))
    return F.when(column.isNull(), 0).otherwise(F.least(coarse * step + fine, F.lit(len(bounds) - 1)))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a table that are worth a task of their own, as by Spark's reader.
SPLIT = 128 << 20


def texts_of(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id as long, text, and the named columns."""
    return spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


def spread(docs: DataFrame) -> DataFrame:
    """The table; one that lies in fewer files than there are cores and would be read by
    fewer tasks is dealt to all cores. Only names and sizes of files are looked at."""
    spark = docs.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, docs.inputFiles()
    if len(files) >= cores:
        return docs
    # Not from files, or from few: a small table, or one whose files split at their row groups.
    small = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < cores * SPLIT
    return docs.repartition(cores) if small else docs


def least_hashes(rows: DataFrame, key: str, k: int, n: int, *ties: str) -> DataFrame:
    """The k rows with the least hashes of `key`, of a table of about n rows: a sample
    that doesn't hang on how the table is cut. Only the lowest share of the hashes,
    some 4 * k rows, reaches the task that picks. Where a few keys hold most rows,
    it may be fewer than k."""
    share = min(1.0, (4 * k + 400) / max(n, 1))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    return rows.where(F.xxhash64(key) <= F.lit(bound).cast("long")).orderBy(F.xxhash64(key), key, *ties).limit(k)


def running_start(df: DataFrame, order: str, tie: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows before this one in ascending order.

    Rows are dealt to ranges of `order`; sums of ranges (a few numbers a shuffle
    partition) pass the driver, the rest is a window within each range. Rows
    with a null come first.
    """
    from pyspark.sql import Window

    bounds = range_bounds(df, order, 4 * shuffle_width(df.sparkSession)) or [0]
    dealt = df.withColumn("_range", range_of(F.col(order), bounds))
    sums = {r[0]: r[1] or 0 for r in dealt.groupBy("_range").agg(F.sum(value)).collect()}
    before, total = [], 0
    for i in range(len(bounds)):
        before.append(total)
        total += sums.get(i, 0)
    window = Window.partitionBy("_range").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_range"))
    return dealt.withColumn(name, offset + F.sum(value).over(window) - F.col(value)).drop("_range")


def unplaced(key: Column) -> Column:
    """The same long, as a column by which no table is known to be dealt. An aggregate
    that is joined by it is dealt anew, so that a skewed partition of the other
    side may be split; a join in the aggregate's own partitions can't be."""
    return key.bitwiseXOR(F.lit(0).cast("long"))


#: Bytes of keys that are broadcast at most.
SENT = 16 << 20


def sent(keys: DataFrame, each: int | Column) -> DataFrame:
    """The keys, of about `each` bytes, to be broadcast if all of them take SENT at most;
    beyond, they are joined by shuffling."""
    whole = keys.agg(F.sum(each if isinstance(each, Column) else F.lit(each)).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(keys) if whole <= SENT else keys


def text_mark(text: Column) -> Column:
    """128 bits that stand for a text; null for a null one."""
    return F.md5(text)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them that no column bears them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with columns that tell its rows apart by doc_id and text, and their
    names; nulls are values like any other there."""
    names = fresh(df, "_id", "_absent", "_mark")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.coalesce(text_mark(F.col("text")), F.lit(""))]
    return df.withColumns(dict(zip(names, key, strict=True))), names


def named_keys(found: DataFrame, names: list[str]) -> DataFrame:
    """The distinct keys of rows (doc_id, mark), by the names that row_key gave, and how
    often each occurs (times)."""
    key = [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.coalesce("mark", F.lit(""))]
    return found.select(*[c.alias(n) for n, c in zip(names, key, strict=True)]).groupBy(*names).agg(F.count("*").alias("times"))


def keep_named(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents but those that `found` (doc_id, mark, kept: a row a document) doesn't
    keep, with all their columns; of repeated rows one. Texts are shuffled only
    where they repeat, or where the keys are too many to be broadcast."""
    keyed, names = row_key(docs)
    gone = named_keys(found.where(~F.col("kept")), names).select(*names)
    again = named_keys(found.where("kept"), names).where("times > 1").select(*names)
    again = sent(again, 100)
    once = keyed.join(sent(gone, 100), names, "left_anti").join(again, names, "left_anti")
    return once.union(keyed.join(again, names, "left_semi").dropDuplicates(names)).select(*docs.columns)

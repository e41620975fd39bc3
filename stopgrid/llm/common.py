"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopgrid.plans.storage import scratch, shared_dir, written  # noqa: F401

#: A join key with more rows than total / HEAVY_SHARE is handled by broadcast; at most HEAVY_SHARE keys can be.
HEAVY_SHARE = 10_000
#: Rows of a key table (at most three longs each) up to which it is broadcast whole.
BROADCAST_ROWS = 500_000


def parallel(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch sent to Python. A longer row is a batch of its own.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches limited by bytes, since a row may hold a text of megabytes.

    The setting is the session's and frames read it when they run, so every
    operator here sets the same values: no frame depends on which ran last.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")


def own_name(wanted: str, *frames: DataFrame) -> str:
    """``wanted``, with underscores added until no column of the frames has that name, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def schema_of(df: DataFrame, more: str = "") -> str:
    """The columns of ``df``, and ``more``, as a DDL string."""
    own = [f"`{x.name.replace('`', '``')}` {x.dataType.simpleString()}" for x in df.schema]
    return ", ".join([*own, more] if more else own)


def held() -> Column:
    """Always true, but not to the optimizer: a column that holds it is computed once, where it stands.

    A filter on a column is else pushed below it with all that the column is made
    of put in its place, also inside lambdas, where it would run for each element.
    """
    return F.monotonically_increasing_id() >= 0


def text_of(col: str | Column = "text") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def prefix_sums(lens: Column, block: int = 512) -> Column:
    """Exclusive prefix sums of an array of longs.

    Works in blocks: appending to an array copies it, so one array of n would
    take n squared copies.
    """
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<bigint>")

    def run(arr: Column, start: Column) -> Column:
        out = F.aggregate(
            arr,
            F.struct(start.alias("at"), empty.alias("out")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")),
        )
        return out["out"]

    n = F.size(lens)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(lens, b * block + 1, F.lit(block)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x))
    starts = run(totals, zero)
    whole = F.flatten(F.zip_with(blocks, starts, run))
    return F.when(n == 0, empty).when(n <= block, run(lens, zero)).otherwise(whole)


def join_by_count(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join where ``right`` has one row for each key, and ``count`` tells how many rows of ``left`` have it.

    Keys with more than total / HEAVY_SHARE rows, at most HEAVY_SHARE of them,
    are broadcast; each of the others sends at most that many rows to a task.
    """
    most = max(1000, total // HEAVY_SHARE)
    hot = F.broadcast(right.where(F.col(count) > most).withColumn("__hot", F.lit(True)))
    light = right.where(F.col(count) <= most)
    marked = left.join(hot, keys, "left")
    made = [c for c in right.columns if c not in keys]
    return marked.where("__hot").drop("__hot").unionByName(marked.where("__hot is null").drop("__hot", *made).join(light, keys))

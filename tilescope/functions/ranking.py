"""Top rows, global ranks and exact order statistics that hold up under skew."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilescope.session import checkpointed, written

SLICES = 512  # of the values left in a bracket: a window holds about n / 512 / 128 distinct values


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of every key.

    Written as row_number() <= k so that Spark places a WindowGroupLimit before
    the shuffle: a key that holds a third of the table leaves each task as at
    most k rows.
    """
    name = rank or "__rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def with_global_rank(df: DataFrame, order: Sequence[str], rank: str) -> DataFrame:
    """Number all rows 1..n by `order` (which must be unique) without one big task; nulls come first.

    Rows are dealt out by ranges of the order and written once, so that a lost
    task reads the same rows again. A row's number is its place in its partition
    plus the sizes of the partitions before it.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    # The number given here is the partition's, shifted by 33 bits, plus the row's place in it.
    placed = dealt.withColumn("__at", F.monotonically_increasing_id())
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("__part", part)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: a bounded table, so an unpartitioned window is safe here.
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    offsets = sizes.select("__part", before.alias("__offset"))
    return (
        placed.join(F.broadcast(offsets), "__part")
        .withColumn(rank, (place + F.col("__offset") + 1).cast("long"))
        .drop("__at", "__part", "__offset")
    )


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a per-key table that is usually small.

    The small side is written first, so the optimizer knows its bytes: it is
    broadcast below spark.sql.autoBroadcastJoinThreshold, else both sides are
    shuffled and skewed partitions split.
    """
    return big.join(written(small), list(keys))


def exact_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    position: Callable[[Column], Column],
    name: str,
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact order statistic per key, linear between neighbours.

    `position(n)` gives the zero-based, possibly fractional place in the sorted
    values. Groups may be unbounded, so nothing sorts a whole group: a first
    pass brackets the place with approximate quantiles whose rank error is
    bounded, a second pass counts what lies below the bracket and tallies the
    distinct values inside it. The bracket is cut into slices in turn, and only
    the slices that hold the places are ordered.
    """
    keys = list(keys)
    values = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    grid = 512
    marks = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
    summary = (
        values.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", marks, accuracy).alias("__marks"))
        .withColumn("__pos", position(F.col("__n")).cast("double"))
        # One rank and one grid step of slack on either side: the ranks around the
        # place are inside, and n / grid ranks exceed the error bound n / accuracy.
        .withColumn("__from", F.floor((F.col("__pos") - 1) / F.col("__n") * grid).cast("int") - 1)
        .withColumn("__to", F.ceil((F.col("__pos") + 2) / F.col("__n") * grid).cast("int") + 1)
        .withColumn("__lo", F.get("__marks", F.greatest(F.lit(0), "__from")))
        .withColumn("__hi", F.get("__marks", F.least(F.lit(grid), "__to")))
        .drop("__marks", "__from", "__to")
    )
    if keys:
        placed = join_small(values, summary, keys)
    else:
        one = summary.select(F.struct("__n", "__pos", "__lo", "__hi"))
        placed = values.withColumn("__s", one.scalar()).select("__v", "__s.*")
    carried = [*keys, "__n", "__pos"]
    counted = (
        placed.filter(F.col("__v") <= F.col("__hi"))
        .withColumn("__x", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")))
        .groupBy(*carried, "__x")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    # The distinct values of a bracket are dealt into slices by range, so that none of the windows
    # below holds more than a slice: totals of the slices first, then values inside the one slice
    # (or the two) that hold the places asked for. Null (everything below the bracket) comes first.
    counted = written(counted)
    edges = counted.filter("__x IS NOT NULL").groupBy(*keys).agg(
        F.percentile_approx("__x", F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)]), accuracy).alias("__edges")
    )
    if keys:
        sliced = counted.join(edges.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__edges"),
                              [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], "left").drop(*[f"__k_{k}" for k in keys])
    else:
        sliced = counted.withColumn("__edges", edges.select("__edges").scalar())
    below = F.size(F.filter("__edges", lambda e: e < F.col("__x")))
    sliced = sliced.withColumn("__slice", F.when(F.col("__x").isNull(), -1).otherwise(F.coalesce(below, F.lit(0)))).drop("__edges")
    sums = sliced.groupBy(*carried, "__slice").agg(F.sum("__c").alias("__sum"))
    running = sums.withColumn("__end", F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__slice")))
    lower = F.floor("__pos")
    upper = F.least(lower + 1, F.col("__n") - 1)
    start = F.col("__end") - F.col("__sum")
    needed = running.withColumn("__start", start).filter((F.col("__end") > lower) & (F.col("__start") <= upper))
    needed = needed.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slice").alias("__k_slice"), "__start")
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__slice") == F.col("__k_slice")]
    inside = sliced.join(needed, same)
    upto = Window.partitionBy(*keys, "__slice").orderBy(F.col("__x").asc_nulls_first())
    inside = inside.withColumn("__upto", F.sum("__c").over(upto) + F.col("__start"))
    inside = inside.withColumn("__from", F.col("__upto") - F.col("__c"))

    def value_at(place: Column) -> Column:
        return F.max(F.when((F.col("__from") <= place) & (place < F.col("__upto")), F.col("__x")))

    found = inside.groupBy(*carried).agg(value_at(lower).alias("__a"), value_at(upper).alias("__b"))
    exact = F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__pos") - lower)
    checked = F.when(
        F.col("__a").isNull() | F.col("__b").isNull(),
        F.raise_error(F.lit("order statistic fell outside its bracket")).cast("double"),
    ).otherwise(exact)
    return found.select(*keys, F.col("__n").alias("n_values"), checked.alias(name))

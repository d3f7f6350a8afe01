"""Ordered iteration: rank, first, last, seek, neighbours and ranges in key order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.keys import key_at_least, key_less, shortlex_sort
from siltbed.session import cut, within


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``__task``, ``__row``: the range-partitioned place of each row in ``order``.

    Written once to the shared folder, since a second run of the range partitioning need
    not draw the same borders.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("__task", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return cut(numbered)


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their position (from 1) in ``order``, which should be total.

    No task sees more than its own range: ranges are counted, and the counts of the ranges
    before one (as many rows as there are tasks) are added to its positions.
    """
    rows_at = placed(rows, order)
    counts = rows_at.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__task").alias("__t"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = rows_at.join(F.broadcast(offsets), F.col("__task") == F.col("__t"))
    return joined.withColumn(name, F.col("__row") + F.col("__before") + 1).drop("__task", "__row", "__t", "__before")


def scan(rows: DataFrame, key: str, more: list[Column] | None = None) -> DataFrame:
    """All rows with their position in key order; rows without a key come first."""
    return ranked(rows, [*shortlex_sort(F.col(f"`{key}`")), *(more or [])])


def first(rows: DataFrame, key: str, n: int = 1) -> DataFrame:
    return rows.where(F.col(f"`{key}`").isNotNull()).orderBy(*shortlex_sort(F.col(f"`{key}`"))).limit(n)


def last(rows: DataFrame, key: str, n: int = 1) -> DataFrame:
    return rows.where(F.col(f"`{key}`").isNotNull()).orderBy(*shortlex_sort(F.col(f"`{key}`"), descending=True)).limit(n)


def seek(rows: DataFrame, key: str, target: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows at or above the target."""
    return rows.where(key_at_least(F.col(f"`{key}`"), target)).orderBy(*shortlex_sort(F.col(f"`{key}`"))).limit(n)


def seek_for_prev(rows: DataFrame, key: str, target: Column, n: int = 1) -> DataFrame:
    """The last ``n`` rows below the target, nearest first."""
    return rows.where(key_less(F.col(f"`{key}`"), target)).orderBy(*shortlex_sort(F.col(f"`{key}`"), descending=True)).limit(n)


def range_scan(rows: DataFrame, key: str, low: Column | None, high: Column | None) -> DataFrame:
    """The rows in [low, high); None is an open bound."""
    out = rows.where(F.col(f"`{key}`").isNotNull())
    if low is not None:
        out = out.where(key_at_least(F.col(f"`{key}`"), low))
    return out if high is None else out.where(key_less(F.col(f"`{key}`"), high))


def neighbours(rows: DataFrame, key: str, block: int = 1_000_000) -> DataFrame:
    """Every row with ``prev_key`` and ``next_key`` in key order; keys should be unique.

    Ranks are cut into blocks, and each block also gets the row before and behind it, so
    that the windows are of a fixed size whatever the number of rows.
    """
    at = ranked(rows, shortlex_sort(F.col(f"`{key}`")), "__rank")
    home = F.floor((F.col("__rank") - 1) / block)
    near = F.array_distinct(F.array(F.floor((F.col("__rank") - 2) / block), home, F.floor(F.col("__rank") / block)))
    spread = at.withColumn("__home", home).withColumn("__block", F.explode(near))
    w = Window.partitionBy("__block").orderBy("__rank")
    out = spread.withColumn("prev_key", F.lag(f"`{key}`").over(w)).withColumn("next_key", F.lead(f"`{key}`").over(w))
    return out.where(F.col("__home") == F.col("__block")).drop("__home", "__block", "__rank")


def locate(probes: DataFrame, key: str, ranges: DataFrame, low: str, high: str | None, name: str, strict: bool = False, rows: int = 100_000) -> DataFrame:
    """Every probe with the ``name`` of the range [low, high] that holds its key, else NULL.

    The ranges must be disjoint, as those of the files of a sorted level are; without
    ``high`` each reaches up to the next one. With ``strict`` a range holds only keys above
    its ``low``. The last range that begins at or before a probe is the only one that can
    hold it. NULL keys have no range.

    Up to ``rows`` ranges (they are counted) are sent to every task and searched by
    halving, and the probes stay where they lie. Beyond that ranges and probes are laid out
    in key order together, and a task takes over the last range of the tasks before it, one
    row per task.
    """
    begins = ranges.where(F.col(f"`{low}`").isNotNull())
    if within(begins, rows):
        return _locate_few(probes, key, begins, low, high, name, strict)
    end = F.lit(None).cast("binary") if high is None else F.col(f"`{high}`")
    mark = begins.select(F.col(f"`{low}`").alias("__k"), F.lit(1 if strict else 0).alias("__kind"), F.struct(F.col(f"`{low}`").alias("low"), end.alias("high"), F.col(f"`{name}`").alias("name")).alias("__range"), F.lit(None).cast(probes.schema.simpleString()).alias("__probe"))
    kind = mark.schema["__range"].dataType.simpleString()
    asked = probes.select(F.col(f"`{key}`").alias("__k"), F.lit(0 if strict else 1).alias("__kind"), F.lit(None).cast(kind).alias("__range"), F.struct(*[F.col(f"`{c}`") for c in probes.columns]).alias("__probe"))
    at = placed(mark.unionByName(asked), [F.octet_length("__k").asc_nulls_first(), F.col("__k").asc_nulls_first(), F.col("__kind").asc()])
    upto = Window.partitionBy("__task").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    lasts = at.groupBy("__task").agg(F.max_by("__range", F.when(F.col("__range").isNotNull(), F.col("__row"))).alias("__last"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(F.col("__task").alias("__t"), F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    filled = at.withColumn("__here", F.last("__range", ignorenulls=True).over(upto)).join(F.broadcast(carried), F.col("__task") == F.col("__t"), "left")
    found = F.coalesce("__here", "__carried")
    inside = F.col("__k").isNotNull() & (F.lit(True) if high is None else key_at_least(found["high"], F.col("__k")))
    return filled.where(F.col("__probe").isNotNull()).select("__probe.*", F.when(inside, found["name"]).alias(name))


def _locate_few(probes: DataFrame, key: str, ranges: DataFrame, low: str, high: str | None, name: str, strict: bool) -> DataFrame:
    """``locate`` with the ranges as sorted arrays from a scalar subquery, searched by halving in an expression."""
    order = lambda c: F.struct(F.octet_length(c).alias("n"), F.col(f"`{c}`").alias("k"))
    end = F.lit(None) if high is None else F.col(f"`{high}`")
    listed = F.sort_array(F.collect_list(F.struct(order(low).alias("at"), F.struct(end.alias("high"), F.col(f"`{name}`").alias("name")).alias("to"))))
    table = ranges.agg(listed.alias("r")).select(F.struct(F.transform("r", lambda r: r["at"]).alias("at"), F.transform("r", lambda r: r["to"]).alias("to"), F.size("r").alias("n")))
    sent = table.scalar().alias("__table")
    table, mine = F.col("__table"), F.struct(F.octet_length("__k").alias("n"), F.col("__k").alias("k"))

    def step(s, _):
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        here = F.get(table["at"], middle)
        below = (here < mine) if strict else (here <= mine)
        halved = F.struct(F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(middle).alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).otherwise(halved)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(table["n"] + 1)).cast("int"))
    begun = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), table["n"].alias("hi")), step)["lo"]
    place = F.when(F.col("__k").isNotNull() & (begun > 0), begun - 1)
    asked = probes.select(*[F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(probes.columns)], F.col(f"`{key}`").alias("__k"), sent)
    asked = asked.select("*", F.get(table["to"], place).alias("__found"))
    inside = F.col("__found").isNotNull() & (F.lit(True) if high is None else key_at_least(F.col("__found.high"), F.col("__k")))
    return asked.select(*[F.col(f"__p{i}").alias(c) for i, c in enumerate(probes.columns)], F.when(inside, F.col("__found.name")).alias(name))

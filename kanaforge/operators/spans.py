"""Order over everything and over hot keys: exact ranks, as-of values, trailing windows and running counts, in many tasks.

None of these puts all rows of a key into one task. Ranks and as-of values lay rows out by range of (key, order), so that a hot key fills
as many ranges as it needs; what a range has to know of those before it is one row of each, carried over. Trailing windows cut a key's time into
slices and send the end of each slice along to the next (a halo); running counts add the counts of the slices before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kanaforge.sources.scratch import written

#: Bits of a row's place inside its partition in Spark's increasing ids.
_PLACE_BITS = 33
#: Slices of a trailing window are so many windows long: one row of so many is sent along.
SLICE_WINDOWS = 4


def laid_out(df: DataFrame, order: list[Column | str], parts: int | None = None) -> DataFrame:
    """df in ranges of the order, as a table, with _range and _place (from 0, in the range)."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    split = ids.withColumn("_range", F.shiftright("_id", _PLACE_BITS).cast("int")).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    return written(split.drop("_id"))


def ranked(df: DataFrame, order: list[Column | str], into: str = "rank", parts: int | None = None) -> DataFrame:
    """df with its rank from 1 in the order over all rows: places in ranges, and the counts of the ranges before.

    Ranges are as many as shuffle partitions, so their counts are a small table whatever df holds. Ties that the order leaves open are
    ranked in any order; an empty table gives an empty one."""
    rows = laid_out(df, order, parts)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_range").withColumn(into, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def carried(rows: DataFrame, key: list[str], order: list[str], value: Column, into: str, parts: int | None = None) -> DataFrame:
    """rows with the last value of their key that is not null, up to and with the row itself, in the order.

    In a range, by a window over the range's part of a key; before it, from the last value of each range that holds the key."""
    laid = laid_out(rows.withColumn("_value", value), [*key, *order], parts)
    ends = laid.where("_value IS NOT NULL").groupBy(*key, "_range").agg(F.max_by("_value", "_place").alias("_end"))
    places = laid.select(*key, "_range").distinct()
    spans = Window.partitionBy(*key).orderBy("_range")
    known = places.join(ends, [*key, "_range"], "left").withColumn("_past", F.last("_end", True).over(spans.rowsBetween(Window.unboundedPreceding, -1)))
    known = known.where("_past IS NOT NULL").select(*key, "_range", "_past")
    inside = Window.partitionBy(*key, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    here = laid.withColumn("_here", F.last("_value", True).over(inside))
    return here.join(known, [*key, "_range"], "left").withColumn(into, F.coalesce("_here", "_past")).drop("_value", "_here", "_past", "_range", "_place")


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, value: list[str], into: str = "found", parts: int | None = None) -> DataFrame:
    """left with `into`, a struct of the last right row of its key at or before its time; null where there is none.

    key and at are columns of both; value: columns of right. Of right rows at one time the greatest values count. Rows with a null key or
    time find nothing and are kept."""
    kept = [c for c in left.columns if c not in (*key, at)]
    side = left.select(*key, at, F.lit(1).alias("_side"), F.struct(*kept, F.lit(0).alias("_one")).alias("_row"), F.lit(None).cast(right.select(F.struct(*value)).schema[0].dataType).alias("_said"))
    said = right.where(F.col(at).isNotNull()).select(*key, at, F.lit(0).alias("_side"), F.lit(None).cast(side.schema["_row"].dataType).alias("_row"), F.struct(*value).alias("_said"))
    both = carried(side.unionByName(said), key, [at, "_side", "_said"], F.col("_said"), "_last", parts).where("_side = 1")
    usable = F.col(at).isNotNull()
    for k in key:
        usable = usable & F.col(k).isNotNull()
    return both.select(*key, at, *[F.col(f"_row.{c}").alias(c) for c in kept], F.when(usable, F.col("_last")).alias(into))


def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def trailing(rows: DataFrame, key: str, ts: str, window: int, value: Column, into: str, open_start: bool = False, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """rows with the sum of value over their key's rows of the trailing window (microseconds), rows of the same time included.

    open_start: a row exactly one window back does not count. A row is worked out in its slice of the key's time, beside the
    rows of the window before the slice. Rows without a time count for none, and have a null sum."""
    size = window * slice_windows
    at = micros(ts)
    timed = rows.withColumn("_at", at).withColumn("_v", value)
    own = timed.withColumn("_slice", F.expr(f"(_at - pmod(_at, {size}L)) div {size}L")).withColumn("_halo", F.lit(False))
    halo = own.where(F.expr(f"pmod(_at, {size}L) >= {size - window}L")).withColumn("_slice", F.col("_slice") + 1).withColumn("_halo", F.lit(True))
    both = own.unionByName(halo)
    over = Window.partitionBy(key, "_slice").orderBy("_at").rangeBetween(-window + int(open_start), 0)
    summed = both.withColumn(into, F.when(F.col("_at").isNotNull(), F.sum("_v").over(over)))
    return summed.where("NOT _halo").drop("_at", "_v", "_slice", "_halo")


def previous(rows: DataFrame, key: str, order: list[str], value: str, into: str, parts: int | None = None) -> DataFrame:
    """rows with the value of their key's row before them in the order, as a struct (value) or null for the first."""
    laid = laid_out(rows, [key, *order], parts)
    ends = laid.groupBy(key, "_range").agg(F.max_by(F.struct(value), "_place").alias("_end"))
    past = ends.withColumn("_past", F.lag("_end").over(Window.partitionBy(key).orderBy("_range"))).where("_past IS NOT NULL").select(key, "_range", "_past")
    inside = Window.partitionBy(key, "_range").orderBy("_place")
    return laid.withColumn("_here", F.lag(F.struct(value)).over(inside)).join(past, [key, "_range"], "left").withColumn(into, F.coalesce("_here", "_past")).drop("_here", "_past", "_range", "_place")


def running_count(rows: DataFrame, key: list[str], ts: str, tie: list[str], into: str, slice_seconds: int = 3600) -> DataFrame:
    """rows with how many rows of their key there are up to them, by time: the place in the slice and the counts of slices before."""
    size = slice_seconds * 1_000_000
    cut = rows.withColumn("_at", micros(ts)).withColumn("_slice", F.expr(f"(_at - pmod(_at, {size}L)) div {size}L"))
    sizes = cut.groupBy(*key, "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = sizes.select(*key, "_slice", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(*key, "_slice").orderBy("_at", *tie))
    return cut.withColumn("_place", place).join(earlier, [*key, "_slice"]).withColumn(into, (F.col("_before") + F.col("_place")).cast("long")).drop("_at", "_slice", "_place", "_before")

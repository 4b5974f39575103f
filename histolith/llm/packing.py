"""Filling containers of fixed capacity with items, by minimum bin slack.

What decides a packing is how many items of each size there are, and sizes are whole numbers up
to the capacity. So the corpus is counted to a histogram of at most ``capacity`` rows,
which is all the driver ever sees. On it, container after container takes the largest
size left and then the combination of available sizes that fills the rest best, found by
subset-sum dynamic programming on a bitset. A combination is repeated as often as its
sizes last, so the number of different combinations stays in the order of the number of
sizes, whatever the number of items. Items then find their container by their number within
their size, which is counted in parallel with offsets per slice, and by a range join with the
combinations' places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histolith.session import materialize

#: Slices by which the items of one size are numbered in parallel.
SLICES = 64


@dataclass(frozen=True)
class Load:
    """``repeat`` containers from number ``first`` on, each with ``counts[size]`` items of a size."""

    first: int
    repeat: int
    counts: dict[int, int]


def _fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """The subset of items with the greatest sum of at most ``room``.

    ``available`` has (size, count), larger sizes first. Bit s of ``reach`` says that a
    sum of s is possible; counts are split to powers of two, and the search ends as soon as the
    room can be filled to the last unit.
    """
    limit = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # bitset before the step, size, number taken at once
    for size, count in available:
        if size > room:
            continue
        count = min(count, room // size)
        take = 1
        while count:
            take = min(take, count)
            after = (reach | reach << (size * take)) & limit
            if after != reach:
                steps.append((reach, size, take))
                reach = after
            count -= take
            take *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, size, take in reversed(steps):
        if not before >> total & 1:  # the sum needs this step
            chosen[size] = chosen.get(size, 0) + take
            total -= size * take
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> Iterator[Load]:
    """Containers for a histogram of sizes from 1 to ``capacity``."""
    left = {size: n for size, n in histogram.items() if n > 0}
    first = 0
    while left:
        sizes = sorted(left, reverse=True)
        seed = sizes[0]
        counts = {seed: 1}
        rest = [(s, left[s] - (s == seed)) for s in sizes]
        for size, n in _fullest([(s, n) for s, n in rest if n > 0], capacity - seed).items():
            counts[size] = counts.get(size, 0) + n
        repeat = min(left[s] // n for s, n in counts.items())
        yield Load(first, repeat, counts)
        first += repeat
        for s, n in counts.items():
            left[s] -= repeat * n
            if not left[s]:
                del left[s]


def _numbered(pieces: DataFrame, slices: int) -> DataFrame:
    """Adds ``_number``, the place of each piece among those of its size, from 0 on.

    A size may hold a third of all rows: pieces are numbered within (size, slice), and the
    slices' offsets come from their counts, a table of at most sizes x slices rows.
    """
    pieces = pieces.withColumn("_slice", F.pmod(F.xxhash64("_key", "part"), F.lit(slices)))
    counts = pieces.groupBy("size", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("size", "_slice").orderBy("_key", "part", "_twin")
    return (
        pieces.withColumn("_number", F.row_number().over(within) - 1)
        .join(offsets, ["size", "_slice"])
        .withColumn("_number", F.col("_number") + F.col("_offset"))
        .drop("_slice", "_offset")
    )


def pack(items: DataFrame, key: str, size: str, capacity: int, *, slices: int = SLICES) -> DataFrame:
    """``container``, ``key``, ``part``, ``start``, ``size``: where each item, or part of it, goes.

    Only items larger than the capacity are divided: into full parts (numbered from 0, from
    ``start`` on) that have a container of their own, and a remainder that is packed like any
    item. Containers are numbered from 0 without gaps; the sizes in one never exceed the capacity.

    Defined cases: repeated rows are items of their own; a null, negative or zero size takes
    no room, and such an item is spread over the containers by the hash of its key (container 0
    where there is no other); a null key is packed like any; an empty table gives no rows;
    other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    cap = F.lit(capacity).cast("long")
    items = items.select(F.col(key).alias("_key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_size"))
    items = materialize(items.withColumn("_twin", F.monotonically_increasing_id()), "items")
    full = F.floor(F.col("_size") / cap).cast("long")
    rest = F.col("_size") % cap
    parts = F.sequence(F.lit(0).cast("long"), full + F.when((rest > 0) | (F.col("_size") == 0), 0).otherwise(-1))
    pieces = items.select("_key", "_twin", "_size", F.explode(parts).alias("part"))
    pieces = pieces.select("_key", "_twin", F.col("part").cast("int").alias("part"), (F.col("part") * cap).alias("start"), F.least(cap, F.col("_size") - F.col("part") * cap).alias("size"))

    histogram = {r["size"]: r["n"] for r in pieces.where(F.col("size") > 0).groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places, start, number = [], {}, 0
    for load in minimum_bin_slack(histogram, capacity):
        for s, n in load.counts.items():
            lo = start.get(s, 0)
            places.append((s, lo, lo + n * load.repeat, n, load.first))
            start[s] = lo + n * load.repeat
        number = load.first + load.repeat
    spark = items.sparkSession
    places_df = spark.createDataFrame(places, "size bigint, _lo bigint, _hi bigint, _each bigint, _first bigint")
    # One array of intervals per size: a lookup by binary search would not pay, as sizes have few each.
    ranges = places_df.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("_lo", "_hi", "_each", "_first"))).alias("_places"))
    numbered = _numbered(pieces.where(F.col("size") > 0), slices)
    placed = numbered.join(F.broadcast(ranges), "size").withColumn(
        "_place", F.get(F.filter("_places", lambda p: (p["_lo"] <= F.col("_number")) & (F.col("_number") < p["_hi"])), F.lit(0))
    )
    container = F.col("_place._first") + F.floor((F.col("_number") - F.col("_place._lo")) / F.col("_place._each")).cast("long")
    packed = placed.select(container.alias("container"), "_key", "part", "start", "size")
    free = pieces.where(F.col("size") == 0).select(F.pmod(F.xxhash64("_key"), F.lit(max(1, number)).cast("long")).alias("container"), "_key", "part", "start", "size")
    return packed.unionByName(free).withColumnRenamed("_key", key)

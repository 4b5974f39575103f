"""Points near other points, and points in rings, as grid-bucketed equi-joins.

Space is hashed to grid cells whose width follows from the search radius; a point is
joined only with the points of cells its search disk can touch, and every candidate is
verified with the exact distance or the exact winding number. Nothing is broadcast and no
side is ever crossed with the other.

Heavy cells (a third of all points in one cell is assumed possible) are split: the populations
of both sides are counted first; a side that is heavy in a cell gets a salt there, and the
other side is repeated once per salt, in that cell only. Where no cell is heavy, which the counts
tell, nothing is salted and nothing joined for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histolith.session import materialize

EARTH_RADIUS_M = 6_371_008.8
#: Points of one grid cell that one task may hold before the cell is split by salt.
CELL_SPLIT_ROWS = 20_000
METRES_PER_DEGREE = EARTH_RADIUS_M * 3.141592653589793 / 180


def finite(*cols: Column) -> Column:
    """True where every column is neither null nor NaN nor infinite."""
    out = F.lit(True)
    for c in cols:
        c = c.cast("double")
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    return out


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres of coordinates in degrees."""
    f1, f2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((f2 - f1) / 2), 2) + F.cos(f1) * F.cos(f2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _points(df: DataFrame, key: str, x: str, y: str, names: tuple[str, str, str]) -> DataFrame:
    return df.select(F.col(key).alias(names[0]), F.col(x).cast("double").alias(names[1]), F.col(y).cast("double").alias(names[2])).where(
        F.col(names[0]).isNotNull() & finite(F.col(names[1]), F.col(names[2]))
    )


def _touched(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low).cast("long"), F.floor(high).cast("long"))


def _heavy_cells(indexed: DataFrame, queries: DataFrame, cell: list[str], split_rows: int) -> DataFrame | None:
    """Cells in which a side has more than ``split_rows`` rows, with the number of salts of both sides; None where there is none."""
    sides = indexed.select(*cell, F.lit(1).alias("_r"), F.lit(0).alias("_q")).unionByName(queries.select(*cell, F.lit(0).alias("_r"), F.lit(1).alias("_q")))
    counts = sides.groupBy(*cell).agg(F.sum("_r").alias("_r"), F.sum("_q").alias("_q")).where((F.col("_r") > 0) & (F.col("_q") > 0))
    salts = lambda c: F.ceil(F.col(c) / split_rows).cast("int")
    heavy = materialize(counts.where((F.col("_r") > split_rows) | (F.col("_q") > split_rows)).select(*cell, salts("_r").alias("_rs"), salts("_q").alias("_qs")), "heavy-cells")
    return None if heavy.isEmpty() else heavy


def _salted(indexed: DataFrame, queries: DataFrame, cell: list[str], heavy: DataFrame | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns they are joined on, so that no key is heavy on either side."""
    if heavy is None:
        return indexed, queries, cell
    rs, qs = F.coalesce(F.col("_rs"), F.lit(1)), F.coalesce(F.col("_qs"), F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = indexed.join(heavy, cell, "left").withColumn("_salt", F.pmod(F.xxhash64("_rid", "_rx", "_ry"), rs).cast("int")).withColumn("_qsalt", every(qs))
    right = queries.join(heavy, cell, "left").withColumn("_qsalt", F.pmod(F.xxhash64("_qid", "_qx", "_qy"), qs).cast("int")).withColumn("_salt", every(rs))
    return left.drop("_rs", "_qs"), right.drop("_rs", "_qs"), [*cell, "_salt", "_qsalt"]


def near_pairs(
    queries: DataFrame, points: DataFrame, radius: float, *, query_key: str, point_key: str, x: str = "x", y: str = "y", metric: str = "euclidean", split_rows: int = CELL_SPLIT_ROWS, unique: bool = False
) -> DataFrame:
    """``_qid``, ``_qx``, ``_qy``, ``_rid``, ``_rx``, ``_ry``, ``distance`` of all pairs of different positions at most ``radius`` apart.

    With ``unique`` the caller vouches for one row per key on both sides, which saves a shuffle of each.
    """
    if radius < 0 or radius != radius:
        raise ValueError("the radius must be a number of at least 0")
    q = _points(queries, query_key, x, y, ("_qid", "_qx", "_qy"))
    p = _points(points, point_key, x, y, ("_rid", "_rx", "_ry"))
    if metric == "euclidean":
        width = 2.0 * radius if radius > 0 else 1.0
        reach = radius * (1 + 1e-9)  # a point at exactly the radius must not be lost to rounding

        def index(df: DataFrame) -> DataFrame:
            return df.withColumn("_gx", F.floor(F.col("_rx") / width).cast("long")).withColumn("_gy", F.floor(F.col("_ry") / width).cast("long"))

        def look_up(df: DataFrame) -> DataFrame:
            df = df.withColumn("_gx", F.explode(_touched((F.col("_qx") - reach) / width, (F.col("_qx") + reach) / width)))
            return df.withColumn("_gy", F.explode(_touched((F.col("_qy") - reach) / width, (F.col("_qy") + reach) / width)))

        dx, dy = F.col("_qx") - F.col("_rx"), F.col("_qy") - F.col("_ry")
        exact = F.sqrt(dx * dx + dy * dy)
    elif metric == "great_circle":
        step = min(180.0, max(1e-9, 1.0000001 * radius / METRES_PER_DEGREE))
        in_range = lambda a, b: (F.abs(F.col(b)) <= 90) & (F.abs(F.col(a)) <= 360)
        norm = lambda c: F.pmod(F.col(c) + 180.0, F.lit(360.0))
        band = lambda lat: F.floor((lat + 90.0) / step).cast("long")

        def lon_cells(b: Column) -> Column:
            """Number of longitude cells of a band: each at least as wide as the disk's half-width there."""
            worst = F.least(F.lit(90.0), F.greatest(F.abs((b - 1) * step - 90.0), F.abs((b + 2) * step - 90.0)))
            shrink = F.cos(F.radians(worst))
            return F.when(worst + step >= 89.9, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360.0 * shrink / (1.01 * step)))).cast("long")

        def index(df: DataFrame) -> DataFrame:
            df = df.where(in_range("_rx", "_ry")).withColumn("_gy", band(F.col("_ry")))
            return df.withColumn("_gx", F.least(F.floor(norm("_rx") / 360.0 * lon_cells(F.col("_gy"))).cast("long"), lon_cells(F.col("_gy")) - 1))

        def look_up(df: DataFrame) -> DataFrame:
            df = df.where(in_range("_qx", "_qy")).withColumn("_gy", F.explode(F.sequence(band(F.col("_qy")) - 1, band(F.col("_qy")) + 1)))
            n = lon_cells(F.col("_gy"))
            at = F.least(F.floor(norm("_qx") / 360.0 * n).cast("long"), n - 1)
            return df.withColumn("_gx", F.explode(F.array_distinct(F.array(F.pmod(at - 1, n), at, F.pmod(at + 1, n)))))

        exact = great_circle(F.col("_qx"), F.col("_qy"), F.col("_rx"), F.col("_ry"))
    else:
        raise ValueError("metric is euclidean or great_circle")
    cell = ["_gx", "_gy"]
    heavy = _heavy_cells(index(p), look_up(q), cell, split_rows)
    once = (lambda df: df) if unique else (lambda df: df.distinct())
    p, q, keys = _salted(index(once(p)), look_up(once(q)), cell, heavy)
    if unique:
        # The pairs outweigh the rows they come from; by the size of these, adaptive execution would make one task of it all.
        n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        p, q = p.repartition(n, *keys), q.repartition(n, *keys)
    return q.join(p, keys).withColumn("distance", exact).where(F.col("distance") <= radius).drop(*keys)


def points_within(
    queries: DataFrame,
    points: DataFrame,
    radius: float,
    *,
    query_key: str,
    point_key: str,
    x: str = "x",
    y: str = "y",
    metric: str = "euclidean",
    split_rows: int = CELL_SPLIT_ROWS,
    unique: bool = False,
) -> DataFrame:
    """All (query, point) pairs at most ``radius`` apart, with their distance.

    Output columns: ``query_key``, ``point_key``, ``distance``; where both keys have one
    name, the second is called ``<name>_near``. With ``metric="great_circle"`` x is the
    longitude and y the latitude in degrees, and the radius is in metres; the grid then
    is of latitude bands whose longitude step widens towards the poles, and the date
    line is wrapped.

    Defined cases: null keys and null, NaN or infinite coordinates match nothing; repeated
    rows count once; a key with several positions is compared at each and keeps its least
    distance; a radius of 0 matches equal positions; an empty side gives an empty result;
    columns other than key, x and y are ignored, so clashing names do no harm. With ``unique`` the
    caller vouches for one row per key on both sides, and the pairs are not grouped.
    """
    near_name = point_key if point_key != query_key else f"{point_key}_near"
    pairs = near_pairs(queries, points, radius, query_key=query_key, point_key=point_key, x=x, y=y, metric=metric, split_rows=split_rows, unique=unique)
    named = pairs.select(F.col("_qid").alias(query_key), F.col("_rid").alias(near_name), "distance")
    return named if unique else named.groupBy(query_key, near_name).agg(F.min("distance").alias("distance"))


def winding_number(ring: Column, px: Column, py: Column) -> Column:
    """Winding number of an array<struct<x,y>> ring about a point; the last vertex joins the first."""
    n = F.size(ring)

    def step(acc: Column, i: Column) -> Column:
        a = F.get(ring, i)
        b = F.get(ring, F.when(i + 1 == n, F.lit(0)).otherwise(i + 1))
        ax, ay, bx, by = a["x"], a["y"], b["x"], b["y"]
        side = (bx - ax) * (py - ay) - (px - ax) * (by - ay)
        up = (ay <= py) & (by > py) & (side > 0)
        down = (ay > py) & (by <= py) & (side < 0)
        return acc + F.when(up, 1).when(down, -1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)


def points_in_rings(
    points: DataFrame,
    rings: DataFrame,
    *,
    point_key: str,
    ring_key: str,
    x: str = "x",
    y: str = "y",
    ring: str = "ring",
    split_rows: int = CELL_SPLIT_ROWS,
) -> DataFrame:
    """Distinct (point, ring) pairs of the points that lie in the area a ring encloses.

    Every ring is indexed at the grid level whose cell width, a power of two, is at least
    its larger extent, so it covers at most four cells whatever its size; a point is looked
    up once per level that occurs. The number of levels is bounded by the exponents of a
    double and in practice below ten, so that list is the only thing read by the driver.

    Defined cases: null, empty and broken rings (fewer than three vertices, or any vertex
    null, NaN or infinite) and rings without area contain nothing; open and closed rings
    and both directions are equal; a ring that crosses itself encloses the points of
    non-zero winding number. On the boundary, lower and left edges belong to the ring.
    Points with a null key or unusable coordinates match nothing; repeated rows count once.
    """
    ok = F.size("_ring") >= 3
    usable = F.forall("_ring", lambda v: F.coalesce(finite(v["x"], v["y"]), F.lit(False)))
    r = (
        rings.select(F.col(ring_key).alias("_rid"), F.col(ring).alias("_ring"))
        .where(F.col("_rid").isNotNull() & F.col("_ring").isNotNull())
        .where(ok & usable)
        .withColumn("_x0", F.array_min(F.transform("_ring", lambda v: v["x"])))
        .withColumn("_x1", F.array_max(F.transform("_ring", lambda v: v["x"])))
        .withColumn("_y0", F.array_min(F.transform("_ring", lambda v: v["y"])))
        .withColumn("_y1", F.array_max(F.transform("_ring", lambda v: v["y"])))
        .withColumn("_extent", F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")))
        .where(F.col("_extent") > 0)
        .withColumn("_level", F.ceil(F.log2("_extent")).cast("int"))
    )
    levels = sorted(row[0] for row in r.select("_level").distinct().collect())
    width = F.pow(F.lit(2.0), F.col("_level"))
    r = r.withColumn("_gx", F.explode(_touched(F.col("_x0") / width, F.col("_x1") / width)))
    r = r.withColumn("_gy", F.explode(_touched(F.col("_y0") / width, F.col("_y1") / width)))
    p = _points(points, point_key, x, y, ("_qid", "_qx", "_qy"))

    def look_up(df: DataFrame) -> DataFrame:
        df = df.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")))
        return df.withColumn("_gx", F.floor(F.col("_qx") / width).cast("long")).withColumn("_gy", F.floor(F.col("_qy") / width).cast("long"))

    cell = ["_level", "_gx", "_gy"]
    r = r.withColumn("_rx", F.col("_x0")).withColumn("_ry", F.col("_y0"))
    heavy = _heavy_cells(r, look_up(p), cell, max(1, split_rows // 8))
    r, p, keys = _salted(r, look_up(p.distinct()), cell, heavy)
    inside = p.join(r, keys).where(
        F.col("_qx").between(F.col("_x0"), F.col("_x1")) & F.col("_qy").between(F.col("_y0"), F.col("_y1"))
    ).where(winding_number(F.col("_ring"), F.col("_qx"), F.col("_qy")) != 0)
    ring_name = ring_key if ring_key != point_key else f"{ring_key}_ring"
    return inside.select(F.col("_qid").alias(point_key), F.col("_rid").alias(ring_name)).distinct()

"""Pixel operators: dense grids, stencils and window functionals over tiles.

A picture is a long table (px, py, v) of the pixels that differ from the fill value. It is cut to square tiles; each
pixel is sent to its own tile and, within the halo, to its neighbours, so one shuffle of the sparse pixels is all
a stencil needs, whatever the size of its window. A tile becomes a dense numpy array, the window function runs
vectorised over it, and dense rows come out. The size of a tile bounds the memory of a task even where molecules pile up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histolith.session import ship_package

TILE = 256


@dataclass(frozen=True)
class Extent:
    """Pixels from (x0, y0) to (x1, y1), both included."""

    x0: int
    y0: int
    x1: int
    y1: int

    @classmethod
    def of(cls, pixels: DataFrame) -> Extent | None:
        r = pixels.agg(F.min("px"), F.min("py"), F.max("px"), F.max("py")).first()
        return None if r[0] is None else cls(*map(int, r))

    @property
    def width(self) -> int:
        return self.x1 - self.x0 + 1

    @property
    def height(self) -> int:
        return self.y1 - self.y0 + 1


def dense_grid(pixels: DataFrame, value: str, extent: Extent, fill: float = 0) -> DataFrame:
    """px, py, value of every pixel of the extent; absent ones have ``fill``."""
    n = extent.width
    grid = pixels.sparkSession.range(n * extent.height).select((F.col("id") % n + extent.x0).cast("int").alias("px"), (F.floor(F.col("id") / n) + extent.y0).cast("int").alias("py"))
    return grid.join(pixels.select("px", "py", value), ["px", "py"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def _reflect(i: np.ndarray, n: int) -> np.ndarray:
    """Places beyond the border mirrored on the border pixel, which is not repeated."""
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * n - 2)
    return np.where(i >= n, 2 * n - 2 - i, i)


def _symmetric(i: np.ndarray, n: int) -> np.ndarray:
    """Places beyond the border mirrored on its outer edge, so the border pixel is repeated."""
    i = np.where(i < 0, -1 - i, i) % (2 * n)
    return np.where(i >= n, 2 * n - 1 - i, i)


PADS = {"reflect": _reflect, "symmetric": _symmetric}


def window_map(
    pixels: DataFrame,
    value: str,
    extent: Extent,
    fn: Callable[[np.ndarray], dict[str, np.ndarray]],
    outputs: list[str],
    *,
    radius: int,
    pad: str = "zero",
    fill: float = 0.0,
    tile: int = TILE,
) -> DataFrame:
    """Apply ``fn`` to every tile: px, py and one double column per output, for all pixels of the extent.

    ``fn`` gets an array (rows are y, columns are x) with ``radius`` more pixels on each side and returns arrays without
    them. ``pad`` says what lies beyond the extent: ``zero``, ``reflect`` (border pixel not repeated) or ``symmetric``
    (repeated). Results do not depend on the tile size.
    """
    ship_package(pixels.sparkSession)
    ex, r = extent, radius
    cols, rows = -(-ex.width // tile), -(-ex.height // tile)
    if pad != "zero" and min(ex.width, ex.height) <= r:
        raise ValueError("the extent is smaller than the window")
    inside = F.col("px").between(ex.x0, ex.x1) & F.col("py").between(ex.y0, ex.y1)
    src = pixels.where(inside).select((F.col("px") - ex.x0).alias("_x"), (F.col("py") - ex.y0).alias("_y"), F.col(value).cast("double").alias("_v"))

    def reach(c: str, n: int) -> Column:  # tiles whose halo holds the pixel; mirrored halos stay within a tile's own reach
        lo, hi = F.greatest(F.floor((F.col(c) - r) / tile), F.lit(0)), F.least(F.floor((F.col(c) + r) / tile), F.lit(n - 1))
        return F.sequence(lo.cast("int"), hi.cast("int"))

    spread = src.withColumn("_ti", F.explode(reach("_x", cols))).withColumn("_tj", F.explode(reach("_y", rows)))
    frame = pixels.sparkSession.range(cols * rows).select(
        F.lit(None).cast("int").alias("_x"), F.lit(None).cast("int").alias("_y"), F.lit(None).cast("double").alias("_v"),
        (F.col("id") % cols).cast("int").alias("_ti"), F.floor(F.col("id") / cols).cast("int").alias("_tj"),
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(key[0]) * tile, int(key[1]) * tile
        w, h = min(tile, ex.width - x0), min(tile, ex.height - y0)
        gx, gy = np.arange(x0 - r, x0 + w + r), np.arange(y0 - r, y0 + h + r)
        data = np.full((len(gy), len(gx)), fill)
        p = pdf.dropna(subset=["_x"])
        px, py = p["_x"].to_numpy(np.int64) - (x0 - r), p["_y"].to_numpy(np.int64) - (y0 - r)
        ok = (px >= 0) & (px < len(gx)) & (py >= 0) & (py < len(gy))
        data[py[ok], px[ok]] = p["_v"].to_numpy()[ok]
        if pad != "zero":
            mx, my = PADS[pad](gx, ex.width) - (x0 - r), PADS[pad](gy, ex.height) - (y0 - r)
            data = data[np.ix_(my, mx)]
        made = fn(data)
        yy, xx = np.mgrid[y0 : y0 + h, x0 : x0 + w]
        out = {"px": (xx.ravel() + ex.x0).astype(np.int32), "py": (yy.ravel() + ex.y0).astype(np.int32)}
        return pd.DataFrame(out | {o: np.asarray(made[o], np.float64).ravel() for o in outputs})

    return spread.unionByName(frame).groupBy("_ti", "_tj").applyInPandas(run, "px int, py int, " + ", ".join(f"{o} double" for o in outputs))


# window functions --------------------------------------------------------------------------------


def taps(kernel: dict[tuple[int, int], float], radius: int) -> Callable[[np.ndarray], np.ndarray]:
    """Weighted sum over the offsets (dx, dy) of a kernel."""

    def run(a: np.ndarray) -> np.ndarray:
        h, w = a.shape[0] - 2 * radius, a.shape[1] - 2 * radius
        out = np.zeros((h, w))
        for (dx, dy), weight in kernel.items():
            out += weight * a[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
        return out

    return run


def disk(radius: int) -> dict[tuple[int, int], float]:
    """All offsets at most ``radius`` away, of weight 1."""
    span = range(-radius, radius + 1)
    return {(dx, dy): 1.0 for dx in span for dy in span if dx * dx + dy * dy <= radius * radius}


def gaussian(sigma: float, radius: int) -> dict[tuple[int, int], float]:
    line = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    line /= line.sum()
    return {(i - radius, j - radius): float(line[i] * line[j]) for i in range(len(line)) for j in range(len(line))}


def windows(a: np.ndarray, radius: int) -> np.ndarray:
    """View (h, w, k*k) of the windows around each pixel."""
    k = 2 * radius + 1
    v = np.lib.stride_tricks.sliding_window_view(a, (k, k))
    return v.reshape(*v.shape[:2], k * k)


def texture(a: np.ndarray) -> dict[str, np.ndarray]:
    """Entropy, homogeneity and uniformity of the 5 x 5 window, from one sorting of it."""
    win = windows(a, 2)
    n = win.shape[-1]
    ordered = np.sort(win, axis=-1)
    entropy = np.zeros(win.shape[:2])
    run = np.ones(win.shape[:2])
    for i in range(1, n + 1):  # length of each run of equal values
        same = ordered[..., i] == ordered[..., i - 1] if i < n else np.zeros(win.shape[:2], bool)
        p = run / n
        entropy -= np.where(same, 0.0, p * np.log(p))
        run = np.where(same, run + 1, 1)
    centre = win[..., n // 2]
    near = 1.0 / (1.0 + np.abs(win - centre[..., None]))
    return {"entropy": entropy, "homogeneity": (near.sum(-1) - 1.0) / (n - 1), "uniformity": np.log(n) - entropy}


def energy(a: np.ndarray) -> dict[str, np.ndarray]:
    """log10 of the Gaussian mean of squares (sigma 1, radius 5), plus 1."""
    return {"energy": np.log10(taps(gaussian(1.0, 5), 5)(a * a) + 1)}


def edge_strength(a: np.ndarray) -> dict[str, np.ndarray]:
    """log10 of the Sobel gradient's length, plus 1."""
    gx = {(1, -1): 1.0, (1, 0): 2.0, (1, 1): 1.0, (-1, -1): -1.0, (-1, 0): -2.0, (-1, 1): -1.0}
    gy = {(dy, dx): w for (dx, dy), w in gx.items()}
    x, y = taps(gx, 1)(a), taps(gy, 1)(a)
    return {"edge": np.log10(np.sqrt(x * x + y * y) + 1)}


def blur5(a: np.ndarray) -> dict[str, np.ndarray]:
    """5 x 5 binomial blur, rounded to whole numbers."""
    line = np.array([1, 4, 6, 4, 1]) / 16
    kernel = {(i - 2, j - 2): float(line[i] * line[j]) for i in range(5) for j in range(5)}
    return {"blur": np.floor(taps(kernel, 2)(a) + 0.5)}


def local_binary_pattern(points: int = 100, radius: int = 3) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    """Uniform, rotation-invariant local binary pattern with bilinear samples on a ring.

    The code is the number of samples at least as bright as the centre where the ring has at most two changes, and
    ``points + 1`` otherwise. The halo is ``radius + 1``.
    """

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        m = radius + 1
        h, w = a.shape[0] - 2 * m, a.shape[1] - 2 * m
        at = lambda dy, dx: a[m + dy : m + dy + h, m + dx : m + dx + w]
        centre, first, last = at(0, 0), None, None
        ones, changes = np.zeros((h, w)), np.zeros((h, w))
        for k in range(points):
            angle = 2 * np.pi * k / points
            fy, fx = round(-radius * np.sin(angle), 5), round(radius * np.cos(angle), 5)
            y, x = int(np.floor(fy)), int(np.floor(fx))
            ty, tx = fy - y, fx - x
            sample = (1 - ty) * ((1 - tx) * at(y, x) + tx * at(y, x + 1)) + ty * ((1 - tx) * at(y + 1, x) + tx * at(y + 1, x + 1))
            bit = sample - centre >= -1e-9
            ones += bit
            if last is None:
                first = bit
            else:
                changes += bit != last
            last = bit
        changes += last != first
        return {"lbp": np.where(changes <= 2, ones, points + 1)}

    return run


def dilate(radius: int) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    """Maximum over a disk, for 0/1 masks."""
    offsets = list(disk(radius))

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        h, w = a.shape[0] - 2 * radius, a.shape[1] - 2 * radius
        out = np.zeros((h, w))
        for dx, dy in offsets:
            np.maximum(out, a[radius + dy : radius + dy + h, radius + dx : radius + dx + w], out=out)
        return {"mask": out}

    return run


def stencil(pixels: DataFrame, value: str, extent: Extent, kernel: dict[tuple[int, int], float], *, pad: str = "zero", target: str = "v", tile: int = TILE) -> DataFrame:
    """Weighted sum of the neighbours of every pixel of the extent."""
    radius = max(max(abs(dx), abs(dy)) for dx, dy in kernel)
    apply = taps(kernel, radius)
    return window_map(pixels, value, extent, lambda a: {target: apply(a)}, [target], radius=radius, pad=pad, tile=tile)


# windows of a registry: the engine's surface for user-defined pixel metrics ---------------------------

REGISTRY: dict[str, tuple[Callable[[np.ndarray], dict[str, np.ndarray]], list[str], int, str]] = {
    "texture": (texture, ["entropy", "homogeneity", "uniformity"], 2, "reflect"),
    "energy": (energy, ["energy"], 5, "symmetric"),
    "edge": (edge_strength, ["edge"], 1, "reflect"),
    "blur": (blur5, ["blur"], 2, "reflect"),
    "lbp": (local_binary_pattern(), ["lbp"], 4, "zero"),
}


def register_window(name: str, fn: Callable[[np.ndarray], dict[str, np.ndarray]], outputs: list[str], radius: int, pad: str = "reflect") -> None:
    """Add a window function under a name, for ``pixel_metric``."""
    REGISTRY[name] = (fn, outputs, radius, pad)


def pixel_metric(pixels: DataFrame, value: str, extent: Extent, name: str, *, tile: int = TILE) -> DataFrame:
    fn, outputs, radius, pad = REGISTRY[name]
    return window_map(pixels, value, extent, fn, outputs, radius=radius, pad=pad, tile=tile)


def otsu_threshold(pixels: DataFrame, value: str) -> DataFrame:
    """One row ``threshold``: the whole number that maximises the variance between the two classes.

    Works on the histogram of whole values, at most one row per grey level; the lowest of equal maxima counts.
    """
    from pyspark.sql import Window

    h = pixels.groupBy(F.col(value).cast("long").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    h = h.withColumn("w0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("g") * F.col("n")).over(up))
    h = h.withColumn("w", F.sum("n").over(everything)).withColumn("s", F.sum(F.col("g") * F.col("n")).over(everything))
    m0, m1 = F.try_divide(F.col("s0"), F.col("w0")), F.try_divide(F.col("s") - F.col("s0"), F.col("w") - F.col("w0"))
    h = h.withColumn("between", F.coalesce(F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(m0 - m1, 2), F.lit(0.0)))
    return h.agg(F.max_by("g", F.struct("between", -F.col("g"))).alias("threshold"))


def quality_density(molecules: DataFrame, extent: Extent, radius: int = 3) -> DataFrame:
    """px, py, qv_density: sum over a disk of the mean quality of each pixel's molecules."""
    q = molecules.where(F.col("qv").isNotNull()).groupBy("px", "py").agg(F.avg("qv").alias("_q"))
    return stencil(q, "_q", extent, disk(radius), target="qv_density")


def ambient_density(molecules: DataFrame, scores: tuple[str, str], extent: Extent, radius: int = 3) -> DataFrame:
    """px, py, ac_density: product of the disk sums of each pixel's greatest values of two scores, null counting as 0."""
    m = molecules.groupBy("px", "py").agg(*[F.max(F.coalesce(s, F.lit(0.0))).alias(f"_s{i}") for i, s in enumerate(scores)])
    both = stencil(m, "_s0", extent, disk(radius), target="_a").join(stencil(m, "_s1", extent, disk(radius), target="_b"), ["px", "py"])
    return both.select("px", "py", (F.col("_a") * F.col("_b")).alias("ac_density"))


def box_counting_dimension(pixels: DataFrame, extent: Extent) -> DataFrame:
    """One row ``dimension``: minus the slope of log(boxes) over log(box size) of the occupied pixels.

    Boxes of 4, 8, 16, ... pixels, up to the whole of the largest square of a power of two within the extent; null for a
    square of fewer than 8 pixels.
    """
    n = int(np.floor(np.log2(min(extent.width, extent.height))))
    side = 2**n
    kept = pixels.select((F.col("px") - extent.x0).alias("x"), (F.col("py") - extent.y0).alias("y")).where((F.col("x") < side) & (F.col("y") < side))
    sized = kept.withColumn("k", F.explode(F.array(*[F.lit(2**i) for i in range(2, n + 1)]).cast("array<int>")))
    boxes = sized.select("k", F.floor(F.col("x") / F.col("k")).alias("bx"), F.floor(F.col("y") / F.col("k")).alias("by")).distinct().groupBy("k").agg(F.count(F.lit(1)).alias("boxes"))
    return boxes.agg((-F.regr_slope(F.ln("boxes"), F.ln("k"))).alias("dimension"))


# rings to pixels ------------------------------------------------------------------------------------


def rasterise(rings: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """keys, px, py of every pixel whose centre lies in the ring (even-odd rule along each row).

    Scan lines: each edge crosses pixel rows, crossings are paired along the row. It runs on Arrow batches of rings;
    a ring yields its pixels in slices, so one giant ring does not have to fit into a batch.
    """
    ship_package(rings.sparkSession)
    kinds = ", ".join(f"`{k}` {rings.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, times, xs, ys, size = [], [], [], [], 0

            def flush() -> pd.DataFrame:
                at = np.repeat(rows, times)
                out = {k: pdf[k].to_numpy()[at] for k in keys}
                return pd.DataFrame(out | {"px": np.concatenate(xs), "py": np.concatenate(ys)})

            for i, ring_ in enumerate(pdf["_ring"]):
                v = np.array([(p["x"], p["y"]) for p in ring_], float)
                for px, py in scan(v[:, 0], v[:, 1]):
                    rows.append(i)
                    times.append(len(px))
                    xs.append(px)
                    ys.append(py)
                    size += len(px)
                if size > 500_000:
                    yield flush()
                    rows, times, xs, ys, size = [], [], [], [], 0
            if size:
                yield flush()

    usable = rings.where((F.size(ring) >= 3)).select(*keys, F.col(ring).alias("_ring"))
    return usable.mapInPandas(run, f"{kinds}, px int, py int")


def scan(vx: np.ndarray, vy: np.ndarray, slab: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pixels of one ring, in slabs of rows: centre (px + 0.5, py + 0.5) inside."""
    wx, wy = np.roll(vx, -1), np.roll(vy, -1)
    for first in range(int(np.floor(vy.min())), int(np.floor(vy.max())) + 1, slab):
        rows = np.arange(first, min(first + slab, int(np.floor(vy.max())) + 1))
        y = rows[:, None] + 0.5
        cross = (vy > y) != (wy > y)
        if not cross.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            at = np.where(cross, vx + (y - vy) / (wy - vy) * (wx - vx), np.inf)
        at = np.ceil(np.sort(at, axis=1) - 0.5)
        left, right = at[:, 0::2], at[:, 1::2]
        left = left[:, : right.shape[1]]
        paired = np.isfinite(right)
        span = (np.where(paired, right, 0) - np.where(paired, left, 0)).astype(np.int64)
        n = int(span.sum())
        if n:
            starts = np.repeat(np.where(np.isfinite(left), left, 0).astype(np.int64).ravel(), span.ravel())
            offset = np.arange(n) - np.repeat(np.cumsum(span.ravel()) - span.ravel(), span.ravel())
            line = np.repeat(np.broadcast_to(rows[:, None], span.shape).ravel(), span.ravel())
            yield (starts + offset).astype(np.int32), line.astype(np.int32)


def rasterised_mean(rings: DataFrame, value: str) -> DataFrame:
    """px, py, mean of ``value`` over the rings that cover the pixel, and their number."""
    return rasterise(rings, [value]).groupBy("px", "py").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("rings"))


def rasterised_owner(rings: DataFrame, key: str) -> DataFrame:
    """px, py and the key of the last ring (the greatest key) that covers the pixel."""
    return rasterise(rings, [key]).groupBy("px", "py").agg(F.max(key).alias(key))

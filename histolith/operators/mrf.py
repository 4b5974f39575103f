"""Smoothing of a probability picture by loopy belief propagation on the 4-neighbour grid.

A binary Markov random field with min-sum messages. Information moves by at most two pixels per axis and iteration, so
all iterations of a tile can be run inside the tile and a halo of twice their number: one shuffle for
the whole fixpoint instead of one per iteration, and a result that does not depend on the tiles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histolith.operators.raster import TILE, Extent, dense_grid, window_map

UNARY_EPS, NORM_EPS = 1e-8, 1e-8
#: Directions in the order of their update, with the shift (dy, dx) of the place a message is read from.
READ_FROM = ((-1, 0), (1, 0), (0, -1), (0, 1))


def _shifted(m: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """m at (i + dy, j + dx), 0 beyond the array."""
    out = np.zeros_like(m)
    h, w = m.shape[:2]
    ys, yt = (slice(0, h + dy), slice(-dy, h)) if dy < 0 else (slice(dy, h), slice(0, h - dy))
    xs, xt = (slice(0, w + dx), slice(-dx, w)) if dx < 0 else (slice(dx, w), slice(0, w - dx))
    out[yt, xt] = m[ys, xs]
    return out


def propagate(p: np.ndarray, beta: float, damping: float, iterations: int, normalise: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised cost of state 0, and label, of every place of ``p``; NaN is outside of the picture.

    Each direction in turn sends from all pixels at once and sees what the directions before it sent in the same
    iteration; a direction's own messages are no input to its update.
    """
    outside = np.isnan(p)
    q = np.where(outside, 0.5, p)
    unary = np.stack([-np.log(1.0 - q + UNARY_EPS), -np.log(q + UNARY_EPS)], axis=-1)
    sent = [np.zeros_like(unary) for _ in READ_FROM]
    incoming = [np.zeros_like(unary) for _ in READ_FROM]
    for _ in range(iterations):
        for d in range(4):
            cost = unary + sum(incoming[k] for k in range(4) if k != d)
            new = np.minimum(cost, cost[..., ::-1] + beta)
            if normalise == "min":
                new = new - new.min(-1, keepdims=True)
            total = new.sum(-1, keepdims=True)
            guard = total <= 0.0 if normalise == "min" else total == 0.0
            new = (1.0 - damping) * sent[d] + damping * new / np.where(guard, NORM_EPS, total)
            new[outside] = 0.0
            sent[d] = new
            incoming[d] = _shifted(new, *READ_FROM[d])
    belief = unary + sum(incoming)
    total = belief.sum(-1)
    share = belief[..., 0] / np.where(total == 0.0, NORM_EPS, total)
    return share, (belief[..., 0] > belief[..., 1]).astype(float)


def smooth(
    pixels: DataFrame, value: str, extent: Extent, *, beta: float = 1.5, damping: float = 0.3, iterations: int = 15, normalise: str = "total", missing: float = 0.0, tile: int = TILE
) -> DataFrame:
    """px, py, belief, label of every pixel of the extent; ``value`` is a probability in [0, 1].

    Pixels without a row have the probability ``missing``; a null or NaN probability counts as that, too. ``belief`` is the
    normalised cost of state 0, as the method defines it, and ``label`` is 1 where the cost of state 0 is the greater one.
    All iterations are run: an early stop would only skip changes below its tolerance.
    """
    halo = 2 * iterations + 1
    clean = pixels.select("px", "py", F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")), F.lit(float(missing))).alias("_p"))
    full = dense_grid(clean, "_p", extent, float(missing))

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        share, label = propagate(a, beta, damping, iterations, normalise)
        inner = slice(halo, -halo)
        return {"belief": share[inner, inner], "label": label[inner, inner]}

    out = window_map(full, "_p", extent, run, ["belief", "label"], radius=halo, fill=float("nan"), tile=tile)
    return out.withColumn("label", F.col("label").cast("int"))

"""Pixel queries work on every pixel of a micrometre."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from histolith.operators import raster
from histolith.plans import models, pixels
from histolith.sources import bundle

QUERIES = {**pixels.QUERIES, **models.QUERIES}
WHOLE = [n for n in QUERIES if n.startswith(("img04", "img05", "img06", "img07", "img08", "img10", "img11", "img12", "agg38", "agg39", "model01"))]


@pytest.mark.parametrize("name", WHOLE)
def test_every_pixel(name, spark, data):
    e = bundle.transcripts(spark, data).agg(F.max("px") - F.min("px") + 1, F.max("py") - F.min("py") + 1).first()
    assert QUERIES[name](spark, data).count() == e[0] * e[1]


def test_clusters_of_every_pixel(spark, data):
    assert len(WHOLE) == 12
    assert QUERIES["model13_pixel_clusters"](spark, data).agg(F.count(F.lit(1))).first()[0] > 20


def test_fractal_dimension_by_hand(spark):
    """Boxes of 4, 8 and 16 pixels of a 16 x 16 square: a diagonal of dimension 1, and one corner."""
    line = spark.createDataFrame([(i, i) for i in range(16)], "px int, py int")
    extent = raster.Extent(0, 0, 15, 15)
    assert raster.box_counting_dimension(line, extent).first()[0] == pytest.approx(1.0)
    four = spark.createDataFrame([(0, 0), (5, 1), (9, 9), (15, 2)], "px int, py int")  # 4 boxes of 4, 3 of 8, 1 of 16
    x, y = [math.log(4), math.log(8), math.log(16)], [math.log(4), math.log(3), 0.0]
    mx, my = sum(x) / 3, sum(y) / 3
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    assert raster.box_counting_dimension(four, extent).first()[0] == pytest.approx(-slope)

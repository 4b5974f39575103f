"""Operators that SQL cannot express: fixed small cases and properties."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from histolith.operators import delaunay, geometry, graphs, mrf, numbering, priors, raster, regions, tabular
from histolith.operators.latest import latest_rows
from histolith.sources import files


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def rings(spark, *items):
    return spark.createDataFrame([(i, ring(p) if p is not None else None) for i, p in items], "cell_id int, ring array<struct<x:double,y:double>>")


SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]


def test_convexity_counts_the_repeated_vertex(spark):
    r = rings(spark, (1, SQUARE), (2, SQUARE + SQUARE[:1]))
    got = r.select("cell_id", geometry.convexity(F.col("ring")).alias("c"), geometry.convexity(F.col("ring"), closed=False).alias("o")).collect()
    assert [(round(x.c, 9), x.o) for x in got] == [(0.6, 1.0)] * 2


def test_hull_repair_and_validity(spark):
    bow = [(0, 0), (2, 2), (2, 0), (0, 2)]
    got = {x.cell_id: x for x in geometry.repair_rings(rings(spark, (1, SQUARE), (2, bow), (3, None), (4, [(0, 0)] * 3)), "cell_id").collect()}
    assert got[1].valid and not got[2].valid and len(got[2].ring) == 4
    assert not got[3].valid and got[3].ring is None and got[4].ring is None


def test_overlap_area(spark):
    moved = [(x + 0.5, y + 0.5) for x, y in SQUARE]
    far = [(x + 50, y) for x, y in SQUARE]
    big = [(-10, -10), (20, -10), (20, 20), (-10, 20)]
    got = {x.cell_id: round(x.overlap_area, 9) for x in geometry.overlap_area(rings(spark, (1, SQUARE), (2, moved), (3, far), (4, big)), "cell_id").collect()}
    assert got == {1: 1.25, 2: 1.25, 3: 0.0, 4: 2.0}


def test_overlap_matches_sampling():
    rng = np.random.default_rng(3)
    for _ in range(5):
        p, q = (np.column_stack([c[0] + r * np.cos(t), c[1] + r * np.sin(t)]) for c, r, t in ((rng.random(2), rng.uniform(0.3, 1, 7), np.linspace(0, 6.2, 7, endpoint=False)) for _ in range(2)))
        at = rng.uniform(-1.2, 2.2, (200_000, 2))

        def inside(ring_):
            a, b = ring_, np.roll(ring_, -1, 0)
            hit = (a[:, 1] > at[:, None, 1]) != (b[:, 1] > at[:, None, 1])
            with np.errstate(all="ignore"):
                x = a[:, 0] + (at[:, None, 1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
            return (hit & (at[:, None, 0] < x)).sum(1) % 2 == 1

        assert geometry.overlap(p, q) == pytest.approx((inside(p) & inside(q)).mean() * 3.4**2, abs=0.03)


def test_islands(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 20.0, 0.0), (4, 100.0, 0.0)], "cell_id long, x double, y double")
    got = {x.cell_id: (x.component, x.island_size) for x in graphs.islands(c).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1)}


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(5)
    names = list(range(300))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(149)] + [(names[200], names[i]) for i in range(201, 260)] + [(7, 7)]
    got = {x.cell_id: x.component for x in graphs.components(spark.range(300).withColumnRenamed("id", "cell_id"), spark.createDataFrame(edges, "src long, dst long")).collect()}
    chain, star = names[:150], names[200:260]
    assert {got[i] for i in chain} == {min(chain)} and {got[i] for i in star} == {min(star)}
    assert all(got[i] == i for i in names[150:200])


def test_nearest_cutoff_is_exclusive(spark):
    q = spark.createDataFrame([(1, 99.0, 0.0), (2, -100.0, 0.0), (3, None, 0.0), (4, 1.0, 0.0)], "q long, x double, y double")
    p = spark.createDataFrame([(7, 0.0, 0.0), (8, 2.0, 0.0)], "p long, x double, y double")
    got = {x.q: (x.p, x.distance) for x in graphs.nearest(q, p, query_key="q", point_key="p", within=100.0).collect()}
    assert got == {1: (8, 97.0), 4: (7, 1.0)}


def pixels(spark, a):
    ys, xs = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y), float(a[y, x])) for y, x in zip(ys, xs)], "px int, py int, v double")


def picture(df, names):
    rows = df.collect()
    w, h = max(r.px for r in rows) + 1, max(r.py for r in rows) + 1
    out = {n: np.zeros((h, w)) for n in names}
    for r in rows:
        for n in names:
            out[n][r.py, r.px] = r[n]
    return out


def test_windows_do_not_depend_on_tiles(spark):
    a = np.random.default_rng(1).integers(0, 5, (23, 31)).astype(float)
    df, ex = pixels(spark, a), raster.Extent(0, 0, 30, 22)
    for name, outputs in (("texture", ["entropy", "homogeneity", "uniformity"]), ("energy", ["energy"]), ("edge", ["edge"]), ("lbp", ["lbp"])):
        big, small = (picture(raster.pixel_metric(df, "v", ex, name, tile=t), outputs) for t in (64, 7))
        for o in outputs:
            assert np.allclose(big[o], small[o])


def test_constant_window(spark):
    out = picture(raster.pixel_metric(pixels(spark, np.ones((5, 5))), "v", raster.Extent(0, 0, 4, 4), "texture"), ["entropy", "homogeneity", "uniformity"])
    assert np.allclose(out["entropy"], 0) and np.allclose(out["homogeneity"], 1) and np.allclose(out["uniformity"], math.log(25))


def test_disk_has_29_taps():
    assert len(raster.disk(3)) == 29


def test_belief_propagation_does_not_depend_on_tiles(spark):
    a = np.random.default_rng(2).random((19, 26))
    df, ex = pixels(spark, a), raster.Extent(0, 0, 25, 18)
    whole = mrf.propagate(a, 1.5, 0.3, 6, "total")
    for tile in (64, 5):
        got = picture(mrf.smooth(df, "v", ex, iterations=6, tile=tile), ["belief", "label"])
        assert np.allclose(got["belief"], whole[0]) and (got["label"] == whole[1]).all()


def test_unary_costs():
    share, label = mrf.propagate(np.array([[0.0, 1.0]]), 1.5, 0.3, 0, "total")
    assert np.allclose(share, [[0, 1]], atol=1e-6) and label.tolist() == [[0, 1]]


def test_regions_across_tiles(spark):
    a = np.zeros((40, 40))
    a[5, 1:39] = 1
    a[6:30, 38] = 1
    a[31, 39] = 1  # one row away from the bar's end
    a[20, 2:6] = 1
    got = regions.connected_regions(pixels(spark, a), tile=8)
    assert got.groupBy("region").count().count() == 3
    boxes = spark.createDataFrame([(0, 0, 2, 2), (1, 1, 3, 3), (5, 5, 6, 6)], "x0 int, y0 int, x1 int, y1 int")
    assert [tuple(r) for r in regions.merge_boxes(boxes).collect()] == [(0, 0, 3, 3), (5, 5, 6, 6)]


def test_triangles(spark):
    rng = np.random.default_rng(4)
    pts = rng.random((400, 2)) * 300
    cells = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(999, None, 1.0)], "cell_id long, x double, y double")
    tri = delaunay.triangulate(pts)
    centre, r2 = delaunay.circumcircles(pts, tri)
    assert not (((pts[None] - centre[:, None]) ** 2).sum(-1) < r2[:, None] * (1 - 1e-9)).any()
    want = {tuple(sorted(t)) for t in tri.tolist()}
    got = [(r.a, r.b, r.c) for r in delaunay.delaunay(cells, halo=40.0, tile=70.0).collect()]
    assert set(got) == want and len(got) == len(want)


def test_triangles_across_voids_wider_than_the_halo(spark):
    """A ring of cells around an empty middle and a far outlier: the same triangles as of all points at once, in several rounds."""
    rng = np.random.default_rng(8)
    pts = rng.random((600, 2)) * 400
    pts = np.vstack([pts[((pts - 200) ** 2).sum(1) > 120.0**2], [[900.0, 650.0]]])
    cells = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "cell_id long, x double, y double")
    want = {tuple(sorted(t)) for t in delaunay.triangulate(pts).tolist()}
    for rim_points in (10, 10_000):
        rows = delaunay.delaunay(cells, halo=25.0, tile=60.0, rim_points=rim_points).collect()
        assert {(r.a, r.b, r.c) for r in rows} == want and len(rows) == len(want)
    assert max(r.longest for r in rows) > 500
    few = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 0.0)], "cell_id long, x double, y double")
    assert delaunay.delaunay(few).count() == 0 and delaunay.delaunay(few.limit(0)).count() == 0


def test_thirds(spark):
    for n, sizes in ((1, (0, 0, 1)), (2, (0, 1, 1)), (3, (1, 1, 1)), (4, (1, 1, 2)), (5, (1, 2, 2))):
        df = spark.createDataFrame([(i, float(i)) for i in range(n)], "k int, m double")
        levels = [r.level for r in tabular.thirds(df, "k", "m").collect()]
        assert tuple(levels.count(x) for x in ("low", "mid", "high")) == sizes


def test_distance_prior_without_doublets(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "cell_id int, d double")
    assert [r.p for r in priors.distance_prior(df, "d", "p").collect()] == [1.0, 1.0]


def test_mixture_finds_two_modes():
    rng = np.random.default_rng(0)
    _, mean, _ = priors.mixture_1d(np.concatenate([rng.normal(0, 1, 60), rng.normal(20, 1, 60)]), components=2)
    assert np.allclose(np.sort(mean), [0, 20], atol=0.6)


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([("a", i, float(i % 10)) for i in range(300)], "g string, i int, v double")
    r = tabular.bootstrap_means(df, "g", "v", rounds=100).first()
    assert r.low < 4.5 < r.high and r.high - r.low < 1.2


def test_numbering(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i * i) for i in range(200)], "g string, k long")
    got = numbering.numbered(df, ["g"], "k", "n").orderBy("g", "k").collect()
    for g in "ab":
        assert [r.n for r in got if r.g == g] == list(range(1, 1 + sum(r.g == g for r in got)))
    assert numbering.numbered(df.limit(0), ["g"], "k", "n").count() == 0


def test_latest_rows(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 3, "c"), (2, None, "d"), (2, 0, "e"), (None, 9, "f")], "k int, v int, x string")
    assert {(r.k, r.x) for r in latest_rows(df, "k", "v", ["x"]).collect()} == {(1, "c"), (2, "e")}


def test_annotation_separators(spark, tmp_path):
    for i, sep in enumerate("\t,;"):
        f = tmp_path / f"a{i}.txt"
        f.write_text(f"Barcode{sep}Cluster\ncell_1{sep}T cell (x)\n")
        assert [tuple(r) for r in files.read_annotation(spark, str(f)).collect()] == [("cell_1", "Tcellx")]


def test_gene_models_from_gzip(spark, tmp_path):
    import gzip

    f = tmp_path / "genes.gtf.gz"
    f.write_bytes(gzip.compress(b'#comment\nchr1\th\tgene\t1\t2\t.\t+\t.\tgene_id "G1"; gene_name "A;B"; gene_type "x"\nchr1\th\texon\t1\t2\t.\t+\t.\tgene_id "G1"\n'))
    assert [(r.gene_id, r.gene_name, r.gene_type) for r in files.read_gene_models(spark, str(f)).collect()] == [("G1", "A;B", "x")]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,), (float("nan"),)], "v double")
    assert {(r.bin, r.n) for r in tabular.histogram(df, "v", 2).collect()} == {(0, 1), (1, 2)}
    assert {(r.bin, r.n) for r in tabular.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 4).collect()} == {(0, 2)}


def test_triangle_is_no_square():
    assert geometry.is_simple(np.array([(0, 0), (1, 0), (0, 1)], float))
    assert not geometry.is_simple(np.array([(0, 0), (1, 0)], float))


def test_section_rings_keep_all_vertices(spark, data):
    from histolith.plans.spatial import QUERIES
    from histolith.sources import bundle

    vertices = bundle.rings(spark, data).agg(F.sum(F.size("ring"))).first()[0]
    got = QUERIES["geom05_section_rings"](spark, data)
    low = got.agg(F.count(F.lit(1)), F.min("px"), F.min("py")).first()
    assert low[0] == vertices and low[1] >= 1 and low[2] >= 1


def test_celltype_bounds_take_the_branch_of_the_class_sizes(spark):
    """Median and MAD by hand: clean 10 -+ 2, doublets 30 -+ 4, nucleus-free 2 -+ 1."""
    clean, double, free = [8, 10, 12], [26, 30, 34], [1, 2, 3]

    def rows(kind, n_double, n_free, n_clean=3):
        many = lambda v, n: [v[i % 3] for i in range(n)]
        return [(kind, "none", float(v)) for v in many(clean, n_clean)] + [(kind, "doublet", float(v)) for v in many(double, n_double)] + [(kind, "nucleus_free", float(v)) for v in many(free, n_free)]

    table = rows("both", 6, 6) + rows("right", 6, 0) + rows("left", 0, 6) + rows("few", 3, 6) + rows("none", 6, 6, 0) + [(None, "none", 1.0)]
    b = priors.celltype_bounds(spark.createDataFrame(table, "celltype string, artefact string, v double"), ["v"], enough=5)
    assert {r.celltype: (r.low, r.high) for r in b.collect()} == {"both": (3.0, 26.0), "right": (8.0, 26.0), "left": (3.0, 12.0), "few": (8.0, 12.0), "none": (0.0, 0.0)}


def test_long_edges_are_those_of_two_triangles(spark):
    """The quantile leaves the hull out: of two triangles over a long hull the one shared edge is the limit."""
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    t = [(1, 2, 3, ring((0, 0), (2, 0), (0, 90)), 90.0), (1, 2, 4, ring((0, 0), (2, 0), (0, -90)), 90.0)]
    v = delaunay.void_clusters(spark.createDataFrame(t, "a int, b int, c int, ring array<struct<x:double,y:double>>, longest double"), least=2)
    assert [(r.n_triangles, r.cluster != -1) for r in v.collect()] == [(2, True), (2, True)]


def test_stages_are_removed(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from histolith import session

    assert session.materialize(spark.range(3), "kept-for-a-while").count() == 3
    folder = Path(urlparse(session.stage_dir(spark)).path)
    other = folder.parent / "another-application"
    other.mkdir(exist_ok=True)
    assert any(p.name.startswith("kept-for-a-while") for p in folder.iterdir())
    session.remove_stages(spark)
    assert other.exists() and not folder.exists()
    assert session.materialize(spark.range(3), "again").count() == 3
    other.rmdir()

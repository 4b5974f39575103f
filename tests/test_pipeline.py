"""The steps run end to end on the smallest bundle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from histolith import pipeline


@pytest.fixture(scope="module")
def section(spark, data):
    return pipeline.Section(spark, data)


@pytest.mark.parametrize("name", ["annotation", "generalqc", "bubbleqc", "doubletqc", "cellqc"])
def test_cell_steps_keep_every_cell(section, name):
    out = pipeline.STEPS[name](section)
    n = section.cells.count() if name != "bubbleqc" else section.rings.count()
    assert out.count() == n == out.select("cell_id").distinct().count()


def test_layers_and_their_combination(section):
    cell = pipeline.hqcr(section)
    molecule = pipeline.hqtr(section, clusters=8)
    ex = section.extent
    assert cell["hqcr_pixels"].count() == molecule["pixels"].count() == ex.width * ex.height
    assert cell["hqcr_cells"].where((F.col("belief") < -0.01) | (F.col("belief") > 1.01)).count() == 0
    refined = pipeline.hqcr(section, celltype=True)["hqcr_pixels"]
    assert molecule["priors"].where(~F.col("p").between(0, 1)).count() == 0 and molecule["priors"].count() == ex.width * ex.height
    section.results.update({"hqcr_ident": cell, "hqcr_celltype": {"hqcr_pixels": refined}, "hqtr": molecule})
    whole = pipeline.STEPS["combine"](section)
    assert whole["cells"].count() == section.cells.count() and whole["pixels"].count() == ex.width * ex.height
    stain = molecule["pixels"].select("px", "py", (F.col("belief") * 100).cast("int").alias("v"))
    assert pipeline.hqpr(section, stain, clusters=5)["pixels"].count() == ex.width * ex.height
    both = pipeline.combine({"hqcr": cell["hqcr_pixels"], "refined": refined, "hqtr": molecule["pixels"]})
    assert abs(sum(r.fraction for r in both["regions"].collect()) - 1) < 0.01
    assert both["pixels"].where(~F.col("mask_sum").between(0, 3)).count() == 0


def test_molecule_steps(section):
    assert pipeline.doublet_molecules(section).count() == section.molecules.count()
    assert pipeline.molecule_qc(section).agg(F.sum("n")).first()[0] == section.molecules.count()
    assert pipeline.voids(section)["outside"].count() == section.cells.count()
    assert pipeline.ambient(section).where(F.col("morans_i").isNotNull()).count() > 0
    assert pipeline.STEPS["summary"](section).count() > 1
    assert pipeline.summary(section, [pipeline.bubble(section).select("cell_id", "area")]).count() > 1


def test_command_line(spark, data, tmp_path):
    pipeline.main([data, f"file://{tmp_path}/out", "bubbleqc", "transcriptqc"])
    assert spark.read.parquet(f"file://{tmp_path}/out/transcriptqc").count() > 0

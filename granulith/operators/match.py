"""Matching hand labels to particles by mask containment or nearest centroid."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from granulith import constants as K
from granulith.session import join_lookup

#: Pixels of an image row that are searched together.
STRETCH = 64


def match_labels(labels: DataFrame, particles: DataFrame, pixels: DataFrame | None = None,
                 reach: float = K.MATCH_PX, runs: DataFrame | None = None) -> DataFrame:
    """Add particle_id (null = unmatched) to labels (image_id, label_id, cx, cy, ...).

    A label belongs to the particle whose mask holds its rounded centroid, else
    to the nearest centroid within `reach`, ties to the lowest id. Masks come as
    pixels or as runs (image_id, label, y, x0, x1), which may overlap: the lowest
    id owns the pixel. All are equi-joins: pixel coordinates, stretches of an
    image row that a run reaches into, and grid cells of side `reach` where only
    the 3 x 3 neighbourhood can hold a match. Labels and particles at one
    position are collapsed first, so copies never multiply.
    """
    spots = labels.select("image_id", "cx", "cy").distinct()
    found = []
    at = spots.withColumn("y", F.rint("cy").cast("int")).withColumn("x", F.rint("cx").cast("int"))
    held = []
    if pixels is not None:
        held.append(at.join(pixels.where("label <> 0").select("image_id", "y", "x", F.col("label").cast("long").alias("particle_id")),
                            ["image_id", "y", "x"]))
    if runs is not None:
        stretch = lambda c: F.floor(F.col(c) / STRETCH)
        rows = runs.where("label <> 0").select("image_id", "y", "x0", "x1", F.col("label").cast("long").alias("particle_id"),
                                               F.explode(F.sequence(stretch("x0"), stretch("x1"))).alias("_s"))
        held.append(at.withColumn("_s", stretch("x")).join(rows.hint("merge"), ["image_id", "y", "_s"]).where("x between x0 and x1"))
    if held:
        known = particles.select("image_id", "particle_id")
        # the owner of a pixel is found before it is asked whether that particle is known
        found += [h.groupBy("image_id", "cx", "cy").agg(F.min("particle_id").alias("particle_id"))
                  .join(known, ["image_id", "particle_id"], "left_semi")
                  .select("image_id", "cx", "cy", F.lit(-1.0).alias("_d2"), "particle_id") for h in held]
    cell = lambda c: F.floor(F.col(c) / reach)
    centres = (particles.groupBy("image_id", "cx", "cy").agg(F.min("particle_id").alias("particle_id"))
               .select("image_id", F.col("cx").alias("_px"), F.col("cy").alias("_py"), "particle_id")
               .withColumn("_gx", cell("_px")).withColumn("_gy", cell("_py")))
    around = (spots.withColumn("_gx", F.explode(F.sequence(cell("cx") - 1, cell("cx") + 1)))
              .withColumn("_gy", F.explode(F.sequence(cell("cy") - 1, cell("cy") + 1))))
    dx, dy = F.col("_px") - F.col("cx"), F.col("_py") - F.col("cy")
    near = (around.join(centres, ["image_id", "_gx", "_gy"])
            .withColumn("_d2", dx * dx + dy * dy).where(F.col("_d2") <= reach * reach)
            .select("image_id", "cx", "cy", "_d2", "particle_id"))
    found.append(near)
    candidates = reduce(DataFrame.unionByName, found)
    best = (candidates.groupBy("image_id", "cx", "cy")
            .agg(F.min(F.struct("_d2", "particle_id")).alias("_b"))
            .select("image_id", "cx", "cy", F.col("_b.particle_id").alias("particle_id")))
    return join_lookup(labels, best, ["image_id", "cx", "cy"], "left")


def at_points(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Particle under each query point (image_id, point_id, px, py); background gives null.

    Both sides are shuffled and sorted: pixels often come from few rows, whose size would have them all sent around.
    """
    cut = (points.withColumn("x", F.col("px").cast("int")).withColumn("y", F.col("py").cast("int")))
    mask = pixels.where("label <> 0").select("image_id", "x", "y", F.col("label").alias("particle_id"))
    return cut.join(mask.hint("merge"), ["image_id", "x", "y"], "left").select("image_id", "point_id", "particle_id")

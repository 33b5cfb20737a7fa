"""Region properties from label masks stored as runs: (image_id, label, y, x0, x1, grey), a row's unbroken stretch of one label.

`runs` makes them from pixels (image_id, y, x, label, grey), once. Areas and moments of a run are closed formulas, a
perimeter follows from the overlaps of runs in neighbouring rows, a hull from the ends of rows; so a region costs its
height, not its area. Only the convex hull needs Python.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from granulith import constants as K
from granulith.session import join_lookup

REGION = ["image_id", "label"]


def foreground(pixels: DataFrame) -> DataFrame:
    return pixels.where("label <> 0")


def runs(pixels: DataFrame) -> DataFrame:
    """Runs of the foreground with the sum of their greys (null without grey); a window holds one row of one region."""
    grey = F.sum("grey") if "grey" in pixels.columns else F.lit(None).cast("long")
    at = F.row_number().over(Window.partitionBy(*REGION, "y").orderBy("x"))
    return (foreground(pixels).withColumn("_run", F.col("x") - at).groupBy(*REGION, "y", "_run")
            .agg(F.min("x").alias("x0"), F.max("x").alias("x1"), grey.alias("grey")).drop("_run"))


def pixels_of(rows: DataFrame) -> DataFrame:
    """The pixels (image_id, label, y, x) of runs."""
    return rows.select(*REGION, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def _size() -> Column:
    return (F.col("x1") - F.col("x0") + 1).cast("long")


def _square_sum(n: Column) -> Column:
    """0 + 1 + 4 + ... + n * n; also right below zero, as a difference of two of them."""
    n = n.cast("long")
    return n * (n + 1) * (2 * n + 1) / 6


def basics(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Area, centroid, box, mean grey, equivalent diameter, frame contact and axes per region.

    Axes come from the central second moments of the pixel centres, as
    4 * sqrt(eigenvalue). `images` gives width_px and height_px.
    """
    sized = join_lookup(rows, images.select("image_id", "width_px", "height_px"), ["image_id"]).withColumn("_n", _size())
    n, y, x0, x1 = (F.col(c) for c in ("_n", "y", "x0", "x1"))
    left, right = (x0 == 0).cast("int"), (x1 == F.col("width_px") - 1).cast("int")
    on_edge = F.when((y == 0) | (y == F.col("height_px") - 1), n).otherwise(F.least(n, left + right))
    sx = n * (x0 + x1) / 2
    g = sized.groupBy(*REGION, "width_px", "height_px").agg(
        F.sum(n).alias("area"), F.sum(sx).alias("_x"), F.sum(n * y).alias("_y"),
        F.sum(_square_sum(x1) - _square_sum(x0 - 1)).alias("_xx"), F.sum(n * y * y).alias("_yy"), F.sum(sx * y).alias("_xy"),
        F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.sum("grey").alias("_grey"), F.sum(on_edge).alias("edge_run"))
    area = F.col("area")
    g = g.withColumns({"cx": F.col("_x") / area, "cy": F.col("_y") / area, "mean_grey": F.col("_grey") / area})
    vx, vy = F.col("_xx") / area - F.col("cx") * F.col("cx"), F.col("_yy") / area - F.col("cy") * F.col("cy")
    vxy = F.col("_xy") / area - F.col("cx") * F.col("cy")
    root = F.sqrt(F.pow(vx - vy, 2) / 4 + vxy * vxy)
    mid = (vx + vy) / 2
    diam = F.sqrt(4 * area / F.lit(math.pi))
    return g.select(
        *REGION, "area", "cx", "cy", "min_x", "max_x", "min_y", "max_y", "mean_grey",
        diam.alias("diam_px"),
        ((F.col("min_y") <= 1) | (F.col("min_x") <= 1) | (F.col("max_y") + 1 >= F.col("height_px") - 1)
         | (F.col("max_x") + 1 >= F.col("width_px") - 1)).alias("touches_edge"),
        (F.col("edge_run") / diam).alias("edge_cut"),
        (4 * F.sqrt(F.greatest(F.lit(0.0), mid + root))).alias("major_px"),
        (4 * F.sqrt(F.greatest(F.lit(0.0), mid - root))).alias("minor_px"),
        (0.5 * F.atan2(2 * vxy, vy - vx)).alias("angle"))


def perimeter(rows: DataFrame) -> DataFrame:
    """Four-direction Crofton perimeter per region.

    Crossings of the region border along rows, columns and both diagonals are
    counted; a line of pixels enters and leaves a region equally often, so starts
    are counted and doubled. Along a row every run is one start; along a column or
    diagonal a pixel starts unless the row above holds it, straight or shifted.
    """
    own = rows.select(*REGION, "y", "x0", "x1")
    above = own.select(*REGION, (F.col("y") + 1).alias("y"), F.col("x0").alias("_u0"), F.col("x1").alias("_u1"))

    def held(shift: int) -> Column:
        low, high = F.greatest("x0", F.col("_u0") + shift), F.least("x1", F.col("_u1") + shift)
        return F.greatest(F.lit(0), high - low + 1)

    meet = (own.join(above, [*REGION, "y"]).where((F.col("_u0") <= F.col("x1") + 1) & (F.col("_u1") >= F.col("x0") - 1))
            .groupBy(*REGION).agg(F.sum(held(0)).alias("_column"), F.sum(held(1) + held(-1)).alias("_diagonal")))
    whole = own.groupBy(*REGION).agg(F.count("*").alias("_runs"), F.sum(_size()).alias("_area"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    straight = F.col("_runs") + F.col("_area") - none("_column")
    # line spacing 1 along rows and columns, 1/sqrt(2) along diagonals; both ends of a run count
    return whole.join(meet, REGION, "left").select(*REGION, (F.lit(math.pi / 4) * (
        straight + (2 * F.col("_area") - none("_diagonal")) / math.sqrt(2.0))).alias("perim_px"))


def backfill_perimeter(particles: DataFrame, rows: DataFrame) -> DataFrame:
    """Fill perimeters that are missing (0) from the stored mask; others stay as they are."""
    todo = particles.where(F.coalesce("perim_px", F.lit(0.0)) == 0).select(
        "image_id", F.col("particle_id").alias("label"))
    need = rows.join(todo, REGION, "left_semi")
    measured = perimeter(need).select("image_id", F.col("label").cast("long").alias("particle_id"),
                                      F.col("perim_px").alias("_p"))
    p = F.coalesce(F.col("perim_px"), F.lit(0.0))
    return (particles.join(measured, ["image_id", "particle_id"], "left")
            .withColumn("perim_px", F.when(p == 0, F.coalesce("_p", p)).otherwise(p)).drop("_p"))


def _outer_chain(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left boundary of the convex hull, as x over increasing y."""
    order = np.lexsort((x, y))
    chain: list[tuple[float, float]] = []
    for q in zip(y[order], x[order]):
        while len(chain) > 1:
            (y1, x1), (y2, x2) = chain[-2], chain[-1]
            if (x2 - x1) * (q[0] - y1) < (q[1] - x1) * (y2 - y1):
                break
            chain.pop()
        if not chain or q[0] > chain[-1][0]:
            chain.append(q)
    return np.array([c[0] for c in chain]), np.array([c[1] for c in chain])


def _hull_pixels(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> int:
    """Pixels whose centre lies in the hull of the side midpoints of the row-end pixels."""
    def side(ends):
        px = np.concatenate([ends - 0.5, ends, ends])
        py = np.concatenate([y, y - 0.5, y + 0.5])
        return _outer_chain(py, px)

    ly, lx = side(x0)
    ry, rx = side(-x1)
    rows = np.arange(y.min(), y.max() + 1)
    left, right = np.interp(rows, ly, lx), -np.interp(rows, ry, rx)
    return int((np.floor(right + 1e-9) - np.ceil(left - 1e-9) + 1).sum())


def solidity(rows: DataFrame) -> DataFrame:
    """Area / pixels inside the convex hull.

    Only the two ends of each row can lie on the hull, so a region sends its
    height, not its area, to Python, many regions in one batch; a region never
    exceeds its image.
    """
    ends = rows.groupBy(*REGION, "y").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum(_size()).alias("n"))
    spans = ends.groupBy(*REGION).agg(F.sum("n").alias("_area"), F.collect_list(F.struct("y", "x0", "x1")).alias("_rows"))

    @F.pandas_udf("long")
    def hull(y: pd.Series, x0: pd.Series, x1: pd.Series) -> pd.Series:
        return pd.Series([_hull_pixels(*(np.asarray(v, float) for v in r)) for r in zip(y, x0, x1)], dtype="int64")

    return spans.select(*REGION, (F.col("_area") / hull("_rows.y", "_rows.x0", "_rows.x1")).alias("solidity"))


def median_grey(pixels: DataFrame) -> DataFrame:
    """Median grey per image; pixels become counts per grey value before the shuffle, of which an image has few."""
    counts = pixels.groupBy("image_id", "grey").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("image_id")
    counts = counts.withColumn("_upto", F.sum("_n").over(w.orderBy("grey"))).withColumn("_at", (F.sum("_n").over(w) - 1) / 2)
    low = F.min(F.when(F.col("_upto") > F.floor("_at"), F.col("grey")))
    high = F.min(F.when(F.col("_upto") > F.ceil("_at"), F.col("grey")))
    return counts.groupBy("image_id").agg(((low + high) / 2.0).alias("median_grey"))


def brightness(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """Mean grey of each region minus the image's median grey (background included)."""
    return (join_lookup(regions, median_grey(pixels), ["image_id"])
            .withColumn("bright", F.col("mean_grey") - F.col("median_grey")))


def small_candidates(candidates: DataFrame, occupied: DataFrame, images: DataFrame) -> DataFrame:
    """Small regions worth adding: area in the nm band, round, convex, centre off occupied pixels.

    `candidates` has area, perim_px, solidity, cx, cy; occupied runs are grown by 2.
    """
    npp = F.when(F.col("nm_per_px") > 0, F.col("nm_per_px")).otherwise(K.SMALL_DEFAULT_NM_PER_PX)
    disc = lambda nm: F.lit(math.pi) * F.pow(0.5 * nm / npp, 2)
    perim = F.when(F.col("perim_px") > 0, F.col("perim_px")).otherwise(1.0)
    kept = (join_lookup(candidates, images.select("image_id", "nm_per_px"), ["image_id"])
            .where((F.col("area") >= F.greatest(F.lit(K.MIN_COUNT_AREA_PX), disc(K.SMALL_MIN_NM)))
                   & (F.col("area") <= disc(K.SMALL_MAX_NM))
                   & (4 * math.pi * F.col("area") / (perim * perim) >= K.SMALL_MIN_CIRCULARITY)
                   & (F.col("solidity") >= K.SMALL_MIN_SOLIDITY))
            .withColumn("_y", F.col("cy").cast("int")).withColumn("_x", F.col("cx").cast("int")))
    # growing the few candidate centres instead of every run gives the same test
    near = kept.select("image_id", "label", F.explode(F.sequence(F.col("_y") - 2, F.col("_y") + 2)).alias("y"), "_x")
    hit = (near.join(occupied.select("image_id", "y", "x0", "x1"), ["image_id", "y"])
           .where((F.col("x0") <= F.col("_x") + 2) & (F.col("x1") >= F.col("_x") - 2)).select("image_id", "label").distinct())
    return kept.join(hit, REGION, "left_anti").drop("_y", "_x")


def drop_ghosts(rows: DataFrame, particles: DataFrame) -> DataFrame:
    """Mask runs of labels that became particles; everything else turns into background."""
    ids = particles.select("image_id", F.col("particle_id").cast("int").alias("label"))
    return rows.join(ids, REGION, "left_semi")


def area_floor(rows: DataFrame, particles: DataFrame) -> DataFrame:
    """Stored particles that pass the floors: mask area and pixel diameter."""
    area = rows.groupBy(*REGION).agg(F.sum(_size()).alias("area_px")).select(
        "image_id", F.col("label").cast("long").alias("particle_id"), "area_px")
    from granulith.functions.gates import stored_floor
    return particles.join(area, ["image_id", "particle_id"], "left").where(stored_floor()).drop("area_px")

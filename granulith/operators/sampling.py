"""Picking representative particles and splitting photos for the learning curve."""

from pyspark.sql import DataFrame, functions as F

from granulith import constants as K
from granulith.functions import gates
from granulith.operators.ranking import distributed_row_number
from granulith.session import join_lookup


def spread_bands(particles: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Candidates with their size band: k bands over the 5-95 % part of the size order.

    Candidates are clean particles (measured and not elongated); with fewer than k
    of those the measured ones, then all. Up to k candidates get a band each.
    """
    m = particles.withColumn("_meas", gates.measurable())
    m = m.withColumn("_clean", F.col("_meas") & (gates.aspect_ratio() >= 0.72))
    sizes = m.groupBy(*keys).agg(F.count_if("_clean").alias("_nc"), F.count_if("_meas").alias("_nm"))
    tagged = join_lookup(m, sizes, keys, "inner")
    chosen = tagged.where(F.when(F.col("_nc") >= k, F.col("_clean"))
                          .when(F.col("_nm") > 0, F.col("_meas")).otherwise(F.lit(True)))
    r = distributed_row_number(
        chosen.select(*keys, "particle_id", "diam_nm"), keys,
        [F.col("diam_nm"), F.col("particle_id")], "_rn", size="_n")
    pos = F.col("_rn") - 1
    lo = F.floor(F.col("_n") * 0.05)
    hi = F.greatest(F.lit(1), F.floor(F.col("_n") * 0.95))
    narrow = (hi - lo) >= k
    r = r.withColumns({"_start": F.when(narrow, lo).otherwise(0),
                       "_width": F.when(narrow, hi - lo).otherwise(F.col("_n"))})
    at = pos - F.col("_start")
    # the last band whose left edge floor(width * band / k) is not beyond the position
    band = F.floor(((at + 1) * k - 1) / F.col("_width"))
    few = F.col("_n") <= k
    return (r.where(few | ((at >= 0) & (at < F.col("_width"))))
            .select(*keys, "particle_id", "diam_nm", F.when(few, pos).otherwise(band).cast("int").alias("band")))


def draw(bands: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """One seeded pick per band; another seed re-rolls the set."""
    return (bands.groupBy(*keys, "band")
            .agg(F.min(F.struct(F.xxhash64("particle_id", F.lit(seed)).alias("_h"), "particle_id", "diam_nm")).alias("_p"))
            .select(*keys, "band", "_p.particle_id", "_p.diam_nm"))


def pick_spread(particles: DataFrame, keys: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """k clean particles spread over the size range, one per band."""
    return draw(spread_bands(particles, keys, k), keys, seed)


def _shuffled(photos: DataFrame, order) -> DataFrame:
    return distributed_row_number(photos, ["instrument"], order, "_rn", size="_n")


def holdout(photos: DataFrame, order) -> DataFrame:
    """Every third photo of each instrument, in the given shuffled order, is held out."""
    r = _shuffled(photos, order)
    return r.withColumn("held_out", (F.col("_rn") - 1) % 3 == 0).drop("_rn", "_n")


def nested_subsets(pool: DataFrame, draw_order) -> DataFrame:
    """For each (fraction, draw): that share of every instrument's photos, at least one.

    `draw_order(fraction_column, draw_column)` gives the order columns of one draw.
    """
    draws = F.explode(F.array(*[
        F.struct(F.lit(f).alias("frac"), F.lit(d).alias("draw"))
        for f, reps in K.CURVE_FRACTIONS for d in range(reps if f < 1.0 else 1)]))
    rows = pool.select("*", draws.alias("_d")).select(*pool.columns, "_d.frac", "_d.draw")
    r = distributed_row_number(rows, ["frac", "draw", "instrument"],
                               draw_order(F.col("frac"), F.col("draw")), "_rn", size="_n")
    take = F.greatest(F.lit(1), F.rint(F.col("frac") * F.col("_n")).cast("long"))
    return r.where(F.col("_rn") <= take).drop("_rn", "_n")


def usable_subsets(subsets: DataFrame, rows_per_photo: DataFrame) -> DataFrame:
    """Training rows and photos per subset; subsets under 20 rows are skipped."""
    agg = (subsets.join(rows_per_photo, "image_id").groupBy("frac", "draw")
           .agg(F.sum("n_rows").alias("n_train"), F.count("*").alias("photos_train")))
    return agg.where(F.col("n_train") >= K.CURVE_MIN_ROWS)

"""Row-level decisions about one particle, as column expressions over the particle table.

Every function takes the particle columns by name and stays inside built-in
expressions, so Spark compiles a whole decision chain into one projection.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from granulith import constants as K
from granulith.session import settle


def aspect_ratio() -> Column:
    return F.when(F.col("major_px") != 0, F.col("minor_px") / F.col("major_px")).otherwise(0.0)


def pattern_eligible() -> Column:
    return ((F.col("edge_cut") <= K.PATTERN_MAX_EDGE_CUT)
            & (F.col("solidity") >= K.PATTERN_MIN_SOLIDITY)
            & (aspect_ratio() >= K.PATTERN_MIN_AR))


def ellipse_fill() -> Column:
    ellipse = F.col("major_px") * F.col("minor_px")
    return F.when(ellipse > 0, F.col("diam_px") * F.col("diam_px") / ellipse).otherwise(1.0)


def measurable(user: Column | None = None, excluded: Column | None = None) -> Column:
    """True when the diameter is a real size; a hand-set verdict outranks the gate."""
    user = F.col("user_measurable") if user is None else user
    excluded = F.col("excluded") if excluded is None else excluded
    ar_floor = F.when(F.col("edge_cut") > 0, K.EDGE_MEASURE_MIN_AR).otherwise(K.MEASURE_MIN_AR)
    gate = (~excluded
            & (F.col("edge_cut") <= K.EDGE_MEASURE_MAX)
            & (aspect_ratio() >= ar_floor)
            & (ellipse_fill() >= K.MEASURE_MIN_FILL)
            & (F.col("solidity") >= K.MEASURE_MIN_SOLIDITY))
    return F.coalesce(user, gate)


def circularity() -> Column:
    """4*pi*area / perimeter^2, at most 1; null when the perimeter is too short to be a shape."""
    perim = F.col("perim_px")
    area = F.lit(math.pi) * 0.25 * F.col("diam_px") * F.col("diam_px")
    return F.when(perim >= K.SPHERICITY_MIN_PERIM_PX,
                  F.least(F.lit(1.0), F.lit(4.0 * math.pi) * area / (perim * perim)))


def sphericity_score() -> Column:
    c = circularity()
    stretched = (c - K.SPHERICITY_FLOOR) / (1.0 - K.SPHERICITY_FLOOR)
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), stretched)))


def spherical_measurable() -> Column:
    return measurable() & ~F.col("touches_edge") & circularity().isNotNull()


def has_probs() -> Column:
    return F.size(F.coalesce(F.col("pattern_probs"), F.array().cast("array<double>"))) > 0


def _prob(i: int) -> Column:
    return F.try_element_at(F.col("pattern_probs"), F.lit(i + 1))


def threshold(thresholds: dict | None, name: str) -> float:
    return (thresholds or {}).get(name, K.DEFAULT_THRESHOLDS[name])


def size_aware_pattern(thresholds: dict | None = None) -> Column:
    """Pattern name for a solid particle under the size prior; "" when none is credible."""
    probs = F.col("pattern_probs")
    names = F.array(*[F.lit(p) for p in K.PATTERNS])
    best = F.try_element_at(names, F.array_position(probs, F.array_max(probs)).cast("int"))
    janus, stripe = _prob(0), _prob(1)
    stripe_ok = (stripe >= threshold(thresholds, "stripe_small_min_conf")) & (stripe >= janus)
    janus_ok = ((janus >= threshold(thresholds, "janus_small_min_conf"))
                & (F.col("diam_nm") >= K.JANUS_MIN_NM))
    return (F.when(~has_probs(), "")
            .when(F.col("diam_nm") >= K.PATTERN_SMALL_NM, best)
            .when(stripe_ok, "stripe")
            .when(janus_ok, "janus")
            .otherwise(""))


def solidify_pattern(thresholds: dict | None = None) -> Column:
    """The class of a particle forced to be solid by hand: a pattern, or plain "solid"."""
    named = size_aware_pattern(thresholds)
    ok = has_probs() & pattern_eligible() & (named != "") & (F.col("bright") >= K.PATTERN_MIN_BRIGHT)
    return F.when(ok, named).otherwise("solid")


def reclassify(df: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Set is_solid, pattern and excluded; rows of non-classifiable images stay unclassed.

    Needs a boolean `classifiable` column.
    """
    solid = ((F.col("facet_frac") >= threshold(thresholds, "facet_thresh"))
             & (F.col("diam_nm") >= K.SOLID_MIN_DIAM_NM) & F.col("classifiable"))
    judged = F.col("_solid") & has_probs() & pattern_eligible()
    weak_janus = ((F.col("_guess") == "janus")
                  & (F.col("facet_frac") < threshold(thresholds, "janus_min_solid")))
    sure = F.col("facet_frac") >= threshold(thresholds, "nopattern_solid_conf")
    dim = F.col("bright") < K.PATTERN_MIN_BRIGHT
    drop = F.col("_judged") & (F.col("_named") != "") & dim
    staged = (df.withColumn("_solid", solid)
            .withColumn("_judged", judged)
            .withColumn("_guess", F.when(F.col("_judged"), size_aware_pattern(thresholds)).otherwise(""))
            .withColumn("_named", F.when(weak_janus, "").otherwise(F.col("_guess")))
            .withColumn("_drop", drop))
    return settle(staged, {
        "excluded": F.col("_drop"),
        "pattern": F.when(F.col("_drop"), "").otherwise(F.col("_named")),
        "is_solid": F.when(F.col("_drop"), False)
                     .when(F.col("_judged") & (F.col("_named") == ""), sure)
                     .otherwise(F.col("_solid")),
    }).drop("_solid", "_judged", "_guess", "_named", "_drop")


def count_floor(min_diam_nm: float = 0.0) -> Column:
    """Rows that count as a particle at all; the nm floor only applies to scaled images."""
    return ((F.col("diam_px") >= K.MIN_COUNT_DIAM_PX)
            & ((F.col("nm_per_px") <= 0) | (F.col("diam_nm") > K.MIN_COUNT_DIAM_NM))
            & (F.col("diam_nm") >= min_diam_nm))


def area_floor(area: str = "area_px", small: str = "is_small") -> Column:
    return (F.col(area) >= K.MIN_REGION_AREA_PX) | F.col(small)


def stored_floor(area: str = "area_px") -> Column:
    """The floor re-applied to stored particles: mask area and diameter in pixels."""
    return ((F.coalesce(F.col(area), F.lit(0)) >= K.MIN_COUNT_AREA_PX)
            & (F.col("diam_px") >= K.MIN_COUNT_DIAM_PX))


def classifiable(wanted: bool = True) -> Column:
    det = F.upper("detector")
    readable = (F.when(det.isin(K.CONTRAST_DETECTORS), True)
                .when(det.isin(K.FLAT_DETECTORS), False)
                .otherwise(F.col("structure") >= K.STRUCTURE_MIN))
    return readable & F.lit(wanted)

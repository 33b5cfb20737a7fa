"""The class vocabularies. They look alike and differ on purpose; each has one caller group."""

from pyspark.sql import Column, functions as F

from granulith import constants as K
from granulith.functions import gates


def skip_review() -> Column:
    """Decided by rule (size floor) or not measured: nothing for a reviewer to judge."""
    return (F.col("diam_nm") < K.SOLID_MIN_DIAM_NM) | ~gates.measurable()


def _named_or(fallback: str) -> Column:
    return F.when(F.col("pattern") != "", F.col("pattern")).otherwise(fallback)


def review_class() -> Column:
    return (F.when(F.col("excluded") | F.col("unclassified") | skip_review(), "")
            .when(~F.col("is_solid"), "undercooled")
            .otherwise(_named_or("solid")))


def model_class() -> Column:
    return (F.when(F.col("excluded"), "excluded")
            .when(~F.col("is_solid"), "undercooled")
            .otherwise(_named_or("solid")))


def answer() -> Column:
    return F.when(F.col("pattern").isin(K.PATTERNS), F.col("pattern")).otherwise(K.NOPAT)


def report_class(col: str = "class") -> Column:
    return F.when(F.col(col).isin(K.PATTERNS), F.col(col)).otherwise(K.NOPAT)


def in_composition() -> Column:
    """Measured, sized, on a classifiable image and not marked "class unclear"."""
    return (F.col("classifiable") & (F.col("diam_nm") != 0) & gates.measurable()
            & ~F.col("unclassified"))


def composition_class() -> Column:
    """undercooled or a pattern; null for rows outside the composition."""
    return F.when(in_composition(),
                  F.when(~F.col("is_solid"), "undercooled")
                   .when(F.col("pattern").isin(K.PATTERNS), F.col("pattern")))


def volume_segment() -> Column:
    """Like composition_class, but solids without a pattern stay as "nopattern"."""
    return F.when(in_composition(),
                  F.when(~F.col("is_solid"), "undercooled")
                   .when(F.col("pattern").isin(K.PATTERNS), F.col("pattern"))
                   .otherwise("nopattern"))


def split_state() -> Column:
    return F.when(in_composition(), F.when(F.col("is_solid"), "solid").otherwise("undercooled"))


def classsize_class() -> Column:
    """Bucket of the class-by-size view: no measurement gate, excluded rows out."""
    return F.when(F.col("classifiable") & (F.col("diam_nm") != 0) & ~F.col("excluded"),
                  F.when(~F.col("is_solid"), "undercooled").otherwise(_named_or("solid")))


def confidence(facet_thresh: float = K.DEFAULT_THRESHOLDS["facet_thresh"]) -> Column:
    gate = F.least(F.lit(1.0), F.abs(F.col("facet_frac") - facet_thresh) / max(facet_thresh, 1e-6))
    ranked = F.sort_array("pattern_probs", asc=False)
    gap = F.try_element_at(ranked, F.lit(1)) - F.try_element_at(ranked, F.lit(2))
    named = (F.col("is_solid") & (F.col("pattern") != "")
             & (F.size(F.coalesce("pattern_probs", F.array().cast("array<double>"))) >= 2))
    return F.when(named, F.least(gate, gap)).otherwise(gate)


def certainty_label() -> Column:
    """The class a particle is shown as; null when it carries none."""
    return F.when(~F.col("excluded") & ~F.col("unclassified"),
                  F.when(~F.col("is_solid"), "undercooled").otherwise(_named_or("solid")))


def certainty_value(label: Column) -> Column:
    index = F.array_position(F.array(*[F.lit(p) for p in K.PATTERNS]), label).cast("int")
    return (F.when(label == "undercooled", 1.0 - F.col("facet_frac"))
            .when(label == "solid", F.col("facet_frac"))
            .when(gates.has_probs() & (index > 0),
                  F.try_element_at(F.col("pattern_probs"), F.nullif(index, F.lit(0)))))


def rule_note(label: Column, thresholds: dict | None = None) -> Column:
    """Reason code when a rule, not the network, made a particle undercooled."""
    ff = F.col("facet_frac")
    named = gates.size_aware_pattern(thresholds)
    return (F.when((label != "undercooled") | label.isNull(), "")
            .when(ff < gates.threshold(thresholds, "facet_thresh"), "")
            .when(F.col("diam_nm") < K.SOLID_MIN_DIAM_NM, "size_floor")
            .when((named == "janus") & (ff < gates.threshold(thresholds, "janus_min_solid")),
                  "janus_floor")
            .when(named == "", "no_credible_pattern")
            .otherwise(""))

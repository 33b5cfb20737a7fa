"""Histograms whose bins depend on the data of each selection.

All bar widths are multiples of 5 nm, so one pass counts 5 nm base bins and
every axis, bar and share is derived from that small table.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from granulith import constants as K
from granulith.operators import cells

BASE_NM = 5.0


def base_bins(df: DataFrame, keys: list[str], by: list[str] | None = None, members: DataFrame | None = None) -> DataFrame:
    """Count, volume weight and extremes per 5 nm bin; bins of photos add up to those of their selections."""
    d = F.col("diam_nm")
    return cells.summed(df, keys, {"n": cells.count(), "w": cells.total(d * d * d), "_min": cells.low(d), "_max": cells.high(d)},
                        members, {**{c: F.col(c) for c in by or []}, "base": F.floor(d / BASE_NM).cast("long")})


def nice_width(span: Column, target: int) -> Column:
    raw = F.greatest(F.lit(1.0), span) / target
    width = F.lit(float(K.NICE_WIDTHS[-1]))
    for w in reversed(K.NICE_WIDTHS):
        width = F.when(raw <= w, float(w)).otherwise(width)
    return width


def with_axis(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Add the bar width, the axis ends and the bar index to base bins.

    The window holds base bins of one key, never particles.
    """
    w = Window.partitionBy(*keys)
    lo, hi = F.min("_min").over(w), F.max("_max").over(w)
    out = bins.withColumn("width", nice_width(hi - lo, K.HIST_TARGET_BINS))
    out = (out.withColumn("axis_lo", F.floor(lo / F.col("width")) * F.col("width"))
           .withColumn("_hi", F.ceil(hi / F.col("width")) * F.col("width")))
    out = out.withColumn("n_bins", F.greatest(
        F.lit(1), F.round((F.col("_hi") - F.col("axis_lo")) / F.col("width")).cast("int")))
    index = F.floor((F.col("base") * BASE_NM - F.col("axis_lo")) / F.col("width")).cast("int")
    return out.withColumn("bin", F.least(index, F.col("n_bins") - 1)).drop("_hi", "_min", "_max")


def _edges(df: DataFrame) -> DataFrame:
    left = F.col("axis_lo") + F.col("bin") * F.col("width")
    return df.withColumn("bin_lo", left).withColumn("bin_hi", left + F.col("width"))


def histogram(df: DataFrame, keys: list[str], lo: float | None = None, hi: float | None = None,
              members: DataFrame | None = None) -> DataFrame:
    """Every bar of every key, empty ones included; bars centred in [lo, hi) are highlighted."""
    counts = (with_axis(base_bins(df, keys, members=members), keys)
              .groupBy(*keys, "width", "axis_lo", "n_bins", "bin").agg(F.sum("n").alias("n")))
    axes = counts.select(*keys, "width", "axis_lo", "n_bins").distinct()
    bars = axes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)))
    out = bars.join(counts.select(*keys, "bin", "n"), keys + ["bin"], "left")
    centre = F.col("bin_lo") + F.col("width") / 2
    marked = F.lit(True)
    if lo is not None:
        marked = marked & (centre >= lo)
    if hi is not None:
        marked = marked & (centre < hi)
    return (_edges(out).select(*keys, "bin", "bin_lo", "bin_hi",
                               F.coalesce("n", F.lit(0)).alias("n"), marked.alias("highlighted")))


def stacked(df: DataFrame, keys: list[str], by: str, members: DataFrame | None = None) -> DataFrame:
    """Counts per bar and `by` on one axis shared by all values of `by`."""
    binned = with_axis(base_bins(df, keys, [by], members), keys)
    return (_edges(binned).groupBy(*keys, "bin", "bin_lo", "bin_hi", by)
            .agg(F.sum("n").alias("n")))


def composition_per_bin(df: DataFrame, keys: list[str], cls: str, members: DataFrame | None = None) -> DataFrame:
    """Share of each class in each bar; the axis covers all rows, shares only the classed ones."""
    binned = with_axis(base_bins(df, keys, [cls], members), keys).where(F.col(cls).isNotNull())
    agg = _edges(binned).groupBy(*keys, "bin", "bin_lo", cls).agg(F.sum("n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*keys, "bin"))
    return agg.withColumn("share", F.col("n") / whole)


def volume_histogram(df: DataFrame, keys: list[str], segment: str, members: DataFrame | None = None) -> DataFrame:
    """Percent of the key's whole volume in each bar and segment."""
    binned = with_axis(base_bins(df, keys, [segment], members), keys)
    agg = _edges(binned).groupBy(*keys, "bin", "bin_lo", segment).agg(F.sum("w").alias("_w"))
    whole = F.sum("_w").over(Window.partitionBy(*keys))
    return agg.withColumn("volume_pct", 100.0 * F.col("_w") / whole).drop("_w")


def pattern_size(df: DataFrame, keys: list[str], cls: str, members: DataFrame | None = None) -> DataFrame:
    """Fixed 50 nm panel bins; the last one takes everything above the axis."""
    panel = F.least(F.floor(F.col("diam_nm") / K.PANEL_BIN_NM), F.lit(K.PANEL_BINS - 1)).cast("int")
    return cells.summed(df, keys, {"n": cells.count()}, members, {cls: F.col(cls), "bin": panel})


def in_range_composition(df: DataFrame, keys: list[str], cls: str, lo: float, hi: float,
                         members: DataFrame | None = None) -> DataFrame:
    """Per class: rows with lo <= d <= hi; hi at the axis end means "and above"."""
    lo, hi = min(lo, hi), max(lo, hi)
    inside = F.col("diam_nm") >= lo
    if hi < K.PANEL_AXIS_MAX:
        inside = inside & (F.col("diam_nm") <= hi)
    agg = cells.summed(df, keys, {"n_in": cells.count(inside), "n_all": cells.count()}, members, {cls: F.col(cls)})
    return agg.withColumn("n_in_all", F.sum("n_in").over(Window.partitionBy(*keys)))


def axis_helpers(df: DataFrame, keys: list[str], members: DataFrame | None = None) -> DataFrame:
    """Tick step (a multiple of the bar width) and the emptier top corner of each histogram."""
    bars = (with_axis(base_bins(df, keys, members=members), keys)
            .groupBy(*keys, "width", "n_bins", "bin").agg(F.sum("n").alias("n")))
    k = F.greatest(F.lit(1), F.floor(F.col("n_bins") * 0.4).cast("int"))
    agg = bars.groupBy(*keys, "width", "n_bins").agg(
        F.coalesce(F.max(F.when(F.col("bin") < k, F.col("n"))), F.lit(0)).alias("_left"),
        F.coalesce(F.max(F.when(F.col("bin") >= F.col("n_bins") - k, F.col("n"))), F.lit(0)).alias("_right"))
    step = nice_width(F.col("n_bins") * F.col("width"), 6)
    fitted = F.when(step % F.col("width") != 0, F.ceil(step / F.col("width")) * F.col("width")).otherwise(step)
    corner = F.when((F.col("n_bins") >= 4) & (F.col("_left") < F.col("_right")), "left").otherwise("right")
    return agg.select(*keys, "width", "n_bins", fitted.cast("double").alias("tick_step"),
                      corner.alias("quiet_corner"))

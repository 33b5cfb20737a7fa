"""Volume-weighted composition (each particle counts as its diameter cubed)."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from granulith import constants as K
from granulith.functions import classes
from granulith.operators import cells
from granulith.operators.ranking import drill


def _rows(df: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("diam_nm")
    return (df.select(*keys, d, classes.volume_segment().alias("segment"))
            .where("segment is not null").withColumn("w", d * d * d))


def ratio(total_n: Column, total_w: Column, total_w2: Column, n: Column, w: Column, w2: Column) -> dict:
    """Shares and the delta-method half-width from sums alone.

    sum (w (z - p))^2 = (1 - 2p) * sum_in w^2 + p^2 * sum w^2, so no second pass.
    """
    p = w / total_w
    spread = F.greatest(F.lit(0.0), w2 * (1 - 2 * p) + p * p * total_w2)
    return {"number_share": n / total_n, "volume_share": p,
            "ci_half": K.CI_Z * F.sqrt(spread) / total_w}


def volume_shares(df: DataFrame, keys: list[str], members: DataFrame | None = None) -> DataFrame:
    """One row per key and segment, plus "solid"; keys with a single segment give nothing.

    Sums of photos add up to those of their selections; absent segments appear as zeros.
    """
    w = F.col("w")
    parts = cells.summed(_rows(df, cells.unit(keys, members)), keys, {"n": cells.count(), "w": cells.total(w), "w2": cells.total(w * w)},
                         members, {"segment": F.col("segment")})
    # at most six rows per key are laid out as columns
    agg = parts.groupBy(*keys).agg(
        F.sum("n").alias("n_total"), F.sum("w").alias("_w"), F.sum("w2").alias("_w2"),
        *[F.coalesce(F.sum(F.when(F.col("segment") == s, F.col(c))), F.lit(0)).alias(f"{c}_{s}")
          for s in K.VOLUME_SEGMENTS for c in ("n", "w", "w2")])
    present = sum((F.when(F.col(f"n_{s}") > 0, 1).otherwise(0) for s in K.VOLUME_SEGMENTS), F.lit(0))

    def entry(name: str, n: Column, w: Column, w2: Column) -> Column:
        r = ratio(F.col("n_total"), F.col("_w"), F.col("_w2"), n, w, w2)
        return F.struct(F.lit(name).alias("segment"), n.alias("n"), *[v.alias(k) for k, v in r.items()])

    entries = [entry(s, F.col(f"n_{s}"), F.col(f"w_{s}"), F.col(f"w2_{s}")) for s in K.VOLUME_SEGMENTS]
    entries.append(entry("solid", F.col("n_total") - F.col("n_undercooled"),
                         F.col("_w") - F.col("w_undercooled"), F.col("_w2") - F.col("w2_undercooled")))
    return (agg.where(present > 1)
            .select(*keys, "n_total", F.explode(F.array(*entries)).alias("e"))
            .select(*keys, "n_total", "e.*"))


def half_volume_count(df: DataFrame, keys: list[str], members: DataFrame | None = None) -> DataFrame:
    """How many of the largest particles hold half the volume; keys with a single segment give nothing.

    Only the bin where the running volume crosses the half is opened, then only its volumes are ranked.
    """
    seen = {f"s{i}": (F.col("segment") == s).cast("long") for i, s in enumerate(K.VOLUME_SEGMENTS)}
    kinds = sum((F.when(F.col(f"all_{s}") > 0, 1).otherwise(0) for s in seen), F.lit(0))
    half = F.col("all_w") / 2

    def crossing(level: DataFrame) -> DataFrame:
        # the last bin, from the largest down, that starts below the half
        last = F.min(F.when(F.col("before_w") < half, F.col("low"))).over(Window.partitionBy(*keys))
        return level.where(kinds > 1).withColumn("_last", last).where(F.col("low") == F.col("_last"))

    values = drill(_rows(df, cells.unit(keys, members)), keys, "diam_nm", {"n": F.lit(1), "w": F.col("w"), **seen}, crossing,
                   members, descending=True)[-1]
    one = F.col("low") * F.col("low") * F.col("low")
    below = F.greatest(F.lit(0), F.least(F.col("n"), F.ceil((half - F.col("before_w")) / one) - 1))
    return values.groupBy(*keys).agg((F.min("before_n") + F.sum(below) + 1).alias("half_n"))

"""The number tiles of a result page as one long table: (key, view, tile, value, share)."""

from pyspark.sql import Column, DataFrame, functions as F

from granulith import constants as K
from granulith.functions import classes, gates
from granulith.operators import cells, stats, volume

SUMS = ["n", "d", "w", "w2", "n_scored", "score"]


def page(df: DataFrame, keys: list[str], members: DataFrame | None = None) -> DataFrame:
    """Everything the tiles are made of, one row per key, from a single pass over the particles.

    Particles are first summed per (key, segment, measured), at most fourteen
    rows per key, and those are laid out as columns.
    """
    d = F.col("diam_nm")
    w = d * d * d
    m = stats.with_measured(df).withColumn("segment", classes.volume_segment())
    sized = F.col("measured") & (d != 0)
    scored = sized & gates.spherical_measurable()
    parts = cells.summed(m, keys, {
        "n": cells.count(), "d": cells.total(d), "w": cells.total(w), "w2": cells.total(w * w),
        "n_sized": cells.count(sized), "n_scored": cells.count(scored),
        "score": cells.total(F.when(scored, gates.sphericity_score())),
        "n_unclear": cells.count(F.col("unclassified") & sized), "lo": cells.low(d), "hi": cells.high(d)},
        members, {"segment": F.col("segment"), "measured": F.col("measured")})
    yes = lambda c: F.when(F.col("measured"), F.col(c))
    aggs = [F.sum("n").alias("total"), F.coalesce(F.sum(yes("n")), F.lit(0)).alias("measured"),
            F.sum(yes("d")).alias("d"), F.min(yes("lo")).alias("lo"), F.max(yes("hi")).alias("hi"),
            F.sum("n_sized").alias("n_sized"), F.sum("n_scored").alias("n_scored"), F.sum("score").alias("score"),
            F.sum("n_unclear").alias("n_unclear")]
    for s in K.VOLUME_SEGMENTS:
        aggs += [F.coalesce(F.sum(F.when(F.col("segment") == s, F.col(c))), F.lit(0)).alias(f"{c}_{s}") for c in SUMS]
    return parts.groupBy(*keys).agg(*aggs)


def _per(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def _present(names: list[str]) -> Column:
    return sum((F.when(F.col(f"n_{s}") > 0, 1).otherwise(0) for s in names), F.lit(0))


def _total(c: str, names: list[str]) -> Column:
    return sum((F.col(f"{c}_{s}") for s in names), F.lit(0))


def tiles(df: DataFrame, keys: list[str], members: DataFrame | None = None) -> DataFrame:
    """All, plain, per-class, split and volume tiles of every key."""
    none = F.lit(None).cast("double")
    p = page(df, keys, members).join(stats.d_values(df, keys, members), keys, "left")
    classed = _present(K.CLASS_ORDER) > 1
    n_classed = _total("n", K.CLASS_ORDER)
    count = {c: F.when(classed, F.col(f"n_{c}")).otherwise(0) for c in K.CLASS_ORDER}
    count["solid"] = F.greatest(F.lit(0), F.col("measured") - count["undercooled"] - F.col("n_unclear"))
    mean = _per(F.col("d"), F.col("measured"))
    roundness = ("sphericity", _per(F.col("score"), F.col("n_scored")), _per(F.col("n_scored"), F.col("n_sized")))
    measured = ("measured", F.col("measured"), F.col("measured") / F.col("total"))

    n_all, n_under = _total("n", K.VOLUME_SEGMENTS), F.col("n_undercooled")
    n_solid = n_all - n_under
    both = (n_solid > 0) & (n_under > 0)
    w_all, w2_all = _total("w", K.VOLUME_SEGMENTS), _total("w2", K.VOLUME_SEGMENTS)

    def volume_tile(name: str) -> tuple:
        of = lambda c: (_total(c, K.VOLUME_SEGMENTS) - F.col(f"{c}_undercooled")) if name == "solid" else F.col(f"{c}_{name}")
        r = volume.ratio(F.nullif(n_all, F.lit(0)), F.nullif(w_all, F.lit(0.0)), w2_all, of("n"), of("w"), of("w2"))
        return name, r["volume_share"], r["ci_half"]

    views = [
        ("all", classed, [("mean_size", mean, none), measured, roundness,
                          *[(c, count[c], _per(count[c], F.col("measured"))) for c in K.TILE_CLASSES]]),
        ("plain", ~classed, [("total", F.col("total"), none), measured, roundness, ("mean_size", mean, none),
                             ("range_lo", F.col("lo"), none), ("range_hi", F.col("hi"), none)]),
        *[(f"class:{c}", classed & (F.col(f"n_{c}") > 0), [
            ("total", F.col("total"), none), ("count", F.col(f"n_{c}"), _per(F.col(f"n_{c}"), n_classed)),
            ("mean_size", _per(F.col(f"d_{c}"), F.col(f"n_{c}")), none),
            ("sphericity", _per(F.col(f"score_{c}"), F.col(f"n_scored_{c}")),
             _per(F.col(f"n_scored_{c}"), F.col(f"n_{c}")))]) for c in K.CLASS_ORDER],
        ("split", F.lit(True), [
            ("solid", F.when(both, n_solid), F.when(both, _per(n_solid, n_all))),
            ("undercooled", F.when(both, n_under), F.when(both, _per(n_under, n_all))),
            ("mean", mean, none), *[(q, F.col(q), none) for q in ("d10", "d50", "d90")]]),
        ("volume", _present(K.VOLUME_SEGMENTS) > 1, [volume_tile(c) for c in K.TILE_CLASSES]),
    ]
    rows = F.flatten(F.array(*[
        F.when(shown, F.array(*[
            F.struct(F.lit(view).alias("view"), F.lit(name).alias("tile"), value.cast("double").alias("value"),
                     share.cast("double").alias("share")) for name, value, share in entries]))
         .otherwise(F.array().cast("array<struct<view:string,tile:string,value:double,share:double>>"))
        for view, shown, entries in views]))
    return p.select(*keys, F.explode(rows).alias("t")).select(*keys, "t.*")

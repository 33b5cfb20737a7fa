"""Size statistics and class composition per selection: any key columns, or photos by membership (see `cells`).

Everything is over the measured set: an empty measured set gives zeros or
nulls, never a fall-back to all particles.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from granulith import constants as K
from granulith.functions import classes, gates
from granulith.operators import cells
from granulith.operators.ranking import drill, exact_quantiles

SEL = ["selection_id"]


def with_measured(df: DataFrame) -> DataFrame:
    return df.withColumn("measured", gates.measurable())


def _d() -> Column:
    return F.when(F.col("measured"), F.col("diam_nm"))


def _zero(c: Column, name: str) -> Column:
    return F.coalesce(c, F.lit(0.0)).alias(name)


def _sizes(name: str = "size") -> dict[str, cells.Measure]:
    return {**cells.spread(_d(), name), "min_nm": cells.low(_d()), "max_nm": cells.high(_d())}


def _size_columns(name: str = "size") -> list[Column]:
    return [_zero(cells.mean_of(name), "mean_nm"), _zero(cells.deviation_of(name), "std_nm"),
            _zero(F.col("min_nm"), "min_nm"), _zero(F.col("max_nm"), "max_nm")]


def size_summary(df: DataFrame, keys: list[str], members: DataFrame | None = None) -> DataFrame:
    """Counts and mean / std / min / max of the measured diameters."""
    sums = {"count_total": cells.count(), "count_measured": cells.count(F.col("measured")), **_sizes()}
    return cells.summed(with_measured(df), keys, sums, members).select(*keys, "count_total", "count_measured", *_size_columns())


def image_stats(df: DataFrame, keys: list[str], percentiles: dict[str, float] | None = None,
                members: DataFrame | None = None) -> DataFrame:
    """One row per key: counts over all particles, sizes over measured ones.

    `percentiles` adds more order statistics of the measured sizes to the median.

    n_solid / n_flat are null unless some image of the key is classifiable and
    cover classifiable images only; excluded and unclear rows are neither.
    """
    flat = ~F.col("is_solid") & ~F.col("excluded") & ~F.col("unclassified")
    any_class = F.col("classifiable")
    sums = {
        "count_total": cells.count(), "count_measured": cells.count(F.col("measured")),
        "classifiable": cells.any_of(any_class),
        "n_solid": cells.count(any_class & F.col("is_solid")), "n_flat": cells.count(any_class & flat),
        "n_excluded": cells.count(F.col("excluded")), "has_patterns": cells.any_of(any_class & gates.has_probs()),
        **{f"n_{p}": cells.count(F.col("is_solid") & (F.col("pattern") == p)) for p in K.PATTERNS}, **_sizes()}
    base = cells.summed(with_measured(df), keys, sums, members).select(
        *keys, "count_total", "count_measured", "classifiable",
        *[F.when(any_class, F.col(n)).alias(n) for n in ("n_solid", "n_flat")], "n_excluded", "has_patterns",
        *[f"n_{p}" for p in K.PATTERNS], *_size_columns())
    wanted = {"median_nm": 0.5, **(percentiles or {})}
    order = exact_quantiles(df.where(gates.measurable()), keys, "diam_nm", wanted, members)
    return (base.join(order, keys, "left")
            .withColumn("median_nm", F.coalesce("median_nm", F.lit(0.0))))


def pooled_detectors(df: DataFrame, keys: list[str], members: DataFrame | None = None) -> DataFrame:
    """Image count and the sorted distinct detectors of a pool, blank shown as "?".

    The distinct detector names are a closed vocabulary, so the final list is short.
    """
    per_image = (df.groupBy(*([] if members is not None else keys), "image_id")
                 .agg(F.max("detector").alias("detector"), F.bool_or("classifiable").alias("c")))
    if members is not None:
        per_image = per_image.join(members, "image_id")
    named = F.when(F.coalesce("detector", F.lit("")) == "", "?").otherwise(F.col("detector"))
    return per_image.groupBy(*keys).agg(
        F.count("*").alias("n_images"),
        F.count_if("c").alias("n_classifiable_images"),
        F.concat_ws("+", F.array_sort(F.collect_set(named))).alias("detector"))


def d_values(df: DataFrame, keys: list[str], members: DataFrame | None = None) -> DataFrame:
    """Number-based D10 / D50 / D90 and span of the measured diameters."""
    q = exact_quantiles(df.where(gates.measurable()), keys, "diam_nm",
                        {"d10": 0.1, "d50": 0.5, "d90": 0.9}, members)
    return q.withColumn("span", F.when(F.col("d50") != 0, (F.col("d90") - F.col("d10")) / F.col("d50"))
                        .otherwise(0.0))


def d_values_approx(df: DataFrame, keys: list[str], accuracy: int = 10000) -> DataFrame:
    """One-shuffle variant with a bounded sketch per key, for interactive use at scale."""
    q = F.percentile_approx("diam_nm", [0.1, 0.5, 0.9], accuracy)
    return (df.where(gates.measurable()).groupBy(*keys).agg(q.alias("_q"))
            .select(*keys, F.col("_q")[0].alias("d10"), F.col("_q")[1].alias("d50"),
                    F.col("_q")[2].alias("d90")))


def class_sizes(df: DataFrame, keys: list[str], members: DataFrame | None = None) -> DataFrame:
    """Count, mean, min and max per class; nothing unless a key shows two classes."""
    rows = df.withColumn("cls", classes.composition_class()).where("cls is not null")
    d = F.col("diam_nm")
    sums = {"n": cells.count(), "_sum": cells.total(d), "min_nm": cells.low(d), "max_nm": cells.high(d)}
    agg = cells.summed(rows, keys, sums, members, {"cls": F.col("cls")})
    # at most five class rows per key reach this window
    return (agg.withColumn("_k", F.count("*").over(Window.partitionBy(*keys))).where("_k > 1")
            .select(*keys, "cls", "n", (F.col("_sum") / F.col("n")).alias("mean_nm"), "min_nm", "max_nm"))


def class_counts(df: DataFrame, keys: list[str], members: DataFrame | None = None) -> DataFrame:
    """Measured, unclear, per-class and solid counts; solid is by subtraction from measured."""
    m = with_measured(df).withColumn("cls", classes.composition_class())
    agg = cells.summed(m, keys, {
        "measured": cells.count(F.col("measured")),
        "unclassified": cells.count(F.col("unclassified") & F.col("measured") & (F.col("diam_nm") != 0)),
        **{f"_{c}": cells.count(F.col("cls") == c) for c in K.CLASS_ORDER}}, members)
    present = sum((F.when(F.col(f"_{c}") > 0, 1).otherwise(0) for c in K.CLASS_ORDER), F.lit(0))
    agg = agg.withColumn("_ok", present > 1)
    for c in K.CLASS_ORDER:
        agg = agg.withColumn(c, F.when(F.col("_ok"), F.col(f"_{c}")).otherwise(0))
    return (agg.withColumn("classified", sum((F.col(c) for c in K.CLASS_ORDER), F.lit(0)))
            .withColumn("solid", F.greatest(F.lit(0), F.col("measured") - F.col("undercooled")
                                            - F.col("unclassified")))
            .drop("_ok", *[f"_{c}" for c in K.CLASS_ORDER]))


def sphericity(df: DataFrame, keys: list[str], members: DataFrame | None = None) -> DataFrame:
    """Mean score, raw circularity, scored and total counts: overall, per class and per state."""
    m = (df.where(gates.measurable() & (F.col("diam_nm") != 0))
         .withColumn("state", classes.split_state())
         .withColumn("cls", F.when(F.col("state") == "undercooled", "undercooled")
                     .when((F.col("state") == "solid") & (F.col("pattern") != ""), F.col("pattern")))
         .withColumn("_ok", gates.spherical_measurable())
         .withColumn("_score", F.when(F.col("_ok"), gates.sphericity_score()))
         .withColumn("_circ", F.when(F.col("_ok"), gates.circularity())))
    # one row per key, class and state; the filters only regroup those
    parts = cells.summed(m, keys, {"_score": cells.total(F.col("_score")), "_circ": cells.total(F.col("_circ")),
                                   "_n": cells.count(F.col("_ok")), "_t": cells.count()},
                         members, {"cls": F.col("cls"), "state": F.col("state")})
    filters = F.explode(F.array(
        F.struct(F.lit("all").alias("filter"), F.lit("").alias("value")),
        F.struct(F.lit("class").alias("filter"), F.col("cls").alias("value")),
        F.struct(F.lit("state").alias("filter"), F.col("state").alias("value"))))
    agg = (parts.select("*", filters.alias("_f")).where("_f.value is not null")
           .groupBy(*keys, "_f.filter", "_f.value").agg(
               F.sum("_score").alias("_score"), F.sum("_circ").alias("_circ"),
               F.sum("_n").alias("n_scored"), F.sum("_t").alias("total")))
    n = F.nullif(F.col("n_scored"), F.lit(0))
    return agg.select(*keys, "filter", "value", (F.col("_score") / n).alias("mean_score"),
                      (F.col("_circ") / n).alias("raw_circularity"), "n_scored", "total")


def solid_split(df: DataFrame, keys: list[str], members: DataFrame | None = None) -> DataFrame:
    """Solid and undercooled counts and means; only keys that show both states."""
    s = df.withColumn("state", classes.split_state()).where("state is not null")
    at = {w: F.when(F.col("state") == w, F.col("diam_nm")) for w in ("solid", "undercooled")}
    agg = cells.summed(s, keys, {**{f"n_{w}": cells.count(F.col("state") == w) for w in at},
                                 **{f"_{w}": cells.total(v) for w, v in at.items()}}, members)
    return (agg.where("n_solid > 0 and n_undercooled > 0")
            .select(*keys, "n_solid", "n_undercooled", *[(F.col(f"_{w}") / F.col(f"n_{w}")).alias(f"mean_{w}") for w in at]))


def majority_solid_above(df: DataFrame, keys: list[str], min_n: int = K.MAJORITY_MIN_N,
                         members: DataFrame | None = None) -> DataFrame:
    """Smallest diameter whose tail holds min(min_n, n) rows or more and is at least half solid.

    Inside a tie the order is solids first, so the tails that start inside it are: x solids of the tie with all its
    liquids (best at x = all), or y liquids of the tie (feasible for a closed interval of y).

    A bin whose whole tail will do answers with its own smallest diameter, and nothing above it matters; below the lowest
    such bin only bins are opened in which the solids could still catch up. Keys with one state give nothing.
    """
    s = df.withColumn("state", classes.split_state()).where("state is not null")
    need = F.least(F.lit(min_n), F.col("all_t"))
    both = (F.col("all_a") > 0) & (F.col("all_a") < F.col("all_t"))
    tail_a, tail_t = F.col("before_a") + F.col("a"), F.col("before_t") + F.col("t")
    enough = (tail_t >= need) & (2 * tail_a >= tail_t)
    y_min = F.greatest(F.lit(1), need - F.col("before_t"))
    y_max = F.least(F.col("t") - F.col("a"), 2 * F.col("before_a") - F.col("before_t"))

    def sure(level: DataFrame) -> DataFrame:
        return level.where(both).withColumn("_sure", F.min(F.when(enough, F.col("low"))).over(Window.partitionBy(*keys)))

    def hopeful(level: DataFrame) -> DataFrame:
        # solids at the head of a tail count first, so this is the most that a tail starting in the bin can have
        catch_up = (tail_t >= need) & (2 * F.col("before_a") + F.col("a") >= F.col("before_t"))
        return sure(level).where(catch_up & (F.col("_sure").isNull() | (F.col("low") < F.col("_sure"))))

    coarse, fine, values = drill(s, keys, "diam_nm", {"a": (F.col("state") == "solid").cast("long"), "t": F.lit(1)},
                                 hopeful, members, descending=True)
    ok = ((F.col("a") > 0) & enough) | (y_min <= y_max)
    found = sure(coarse).select(*keys, "_sure").unionByName(sure(fine).select(*keys, "_sure")).unionByName(
        values.where(both & ok).select(*keys, F.col("low").alias("_sure")))
    return found.groupBy(*keys).agg(F.min("_sure").alias("majority_solid_nm"))


def range_share(df: DataFrame, keys: list[str], lo: float | None, hi: float | None,
                members: DataFrame | None = None) -> DataFrame:
    """Measured particles in [lo, hi): count, base and mean inside; an open end is None."""
    d = F.col("diam_nm")
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (d >= lo)
    if hi is not None:
        inside = inside & (d < hi)
    sums = cells.summed(df.where(gates.measurable()), keys, {
        "k": cells.count(inside), "n": cells.count(), "_sum": cells.total(F.when(inside, d))}, members)
    return sums.select(*keys, "k", "n", (F.col("_sum") / F.nullif(F.col("k"), F.lit(0))).alias("mean_inside"))


def pooled_title(titles: DataFrame, keys: list[str]) -> DataFrame:
    """One title for a pool of (key, title) rows, one row per image.

    The longest common prefix of a set is that of its smallest and largest
    member, so two combinable aggregates are enough.
    """
    from granulith.functions.text import common_prefix
    agg = titles.groupBy(*keys).agg(F.min("title").alias("_a"), F.max("title").alias("_b"),
                                    F.count("*").alias("n_images"))
    prefix = F.rtrim(common_prefix(F.col("_a"), F.col("_b")))
    prefix = F.regexp_replace(prefix, r"[ \-_]+$", "")
    return agg.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a"))
                      .when(prefix != "", prefix)
                      .otherwise(F.concat(F.col("n_images").cast("string"), F.lit(" images")))
                      .alias("title"))

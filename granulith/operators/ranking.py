"""Exact order statistics and row numbers for groups of any size.

A window over one group, or a percentile buffer, puts the whole group into one
task. Here a group is cut into value bins (or sorted ranges) first: bin counts
are small and combine on the map side, and only bins are ever sorted.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from granulith.operators import cells
from granulith.session import write_and_read

#: A coarse bin is about 1.6 % wide and holds 1024 fine ones.
FINE_BITS = 10
BINS_PER_E = 64 << FINE_BITS


def value_bin(value: Column) -> Column:
    """Order-preserving fine bin of a double, any sign."""
    scaled = F.floor(F.log1p(F.abs(value)) * BINS_PER_E)
    return F.when(value < 0, -scaled - 1).otherwise(scaled).cast("long")


def _before(keys: list[str], order: str, count: Column, descending: bool = False) -> Column:
    w = (Window.partitionBy(*keys).orderBy(F.desc(order) if descending else F.asc(order))
         .rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.sum(count).over(w), F.lit(0))


def drill(df: DataFrame, keys: list[str], value: str, measures: dict[str, Column], pick, members: DataFrame | None = None,
          descending: bool = False) -> list[DataFrame]:
    """Running sums along a value, opened only where they matter: [coarse bins, fine bins, distinct values].

    The rows' value and measures (row-level numbers) are stored once. A photo's rows become sums per coarse bin, photos'
    sums become the selection's, and `pick` keeps the bins to open; only rows of those are read again, for fine bins and
    then for values. Each level has the keys, `low` (the smallest value), the sums, `before_*` (sums over all that comes
    earlier in the order) and `all_*` (sums of the key). A coarse bin holds 1024 fine ones, so no window is long.
    """
    u, names = cells.unit(keys, members), list(measures)
    v = (df.select(*u, F.col(value).cast("double").alias("_v"), *[c.alias(n) for n, c in measures.items()])
         .where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))
         .withColumn("_fine", value_bin(F.col("_v"))).withColumn("_coarse", F.shiftright("_fine", FINE_BITS)))
    v = write_and_read(v, "values")
    sums = [F.sum(n).alias(n) for n in names]
    held = [f"{kind}_{n}" for kind in ("before", "all") for n in names]

    def running(level: DataFrame, group: list[str], bin_: str) -> list[Column]:
        w = (Window.partitionBy(*group).orderBy(F.desc(bin_) if descending else F.asc(bin_))
             .rowsBetween(Window.unboundedPreceding, -1))
        return [F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names]

    per = v.groupBy(*u, "_coarse").agg(*sums, F.min("_v").alias("low"))
    if members is not None:
        per = per.join(members, cells.PHOTO).groupBy(*keys, "_coarse").agg(*sums, F.min("low").alias("low"))
    whole = Window.partitionBy(*keys)
    level = per.withColumns({f"before_{n}": c for n, c in zip(names, running(per, keys, "_coarse"))}
                            | {f"all_{n}": F.sum(n).over(whole) for n in names})
    levels = [level]
    for opened, bin_ in (("_coarse", "_fine"), ("_fine", "_v")):
        chosen = pick(level).select(*keys, opened, *held)
        if members is not None:
            chosen = chosen.join(members, [k for k in keys if k in members.columns])
        rows = v.join(chosen, [*u, opened])
        group = [*keys, opened, *held]
        level = rows.groupBy(*group, bin_).agg(*sums, *([] if bin_ == "_v" else [F.min("_v").alias("low")]))
        level = level.withColumns({f"before_{n}": F.col(f"before_{n}") + c for n, c in zip(names, running(level, [*keys, opened], bin_))})
        level = level.withColumnRenamed("_v", "low") if bin_ == "_v" else level
        levels.append(level)
    return levels


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    members: DataFrame | None = None) -> DataFrame:
    """Linear-interpolated percentiles per key, one column per entry of `probs`.

    Running counts name the bins that hold the two neighbouring ranks of each percentile; only those are opened.
    """
    def rank(p: float) -> Column:
        return (F.col("all_n") - 1) * F.lit(float(p))

    def low(p: float) -> Column:
        return F.floor(rank(p))

    def high(p: float) -> Column:
        return F.least(low(p) + 1, F.col("all_n") - 1)

    def holds(r: Column) -> Column:
        return (r >= F.col("before_n")) & (r < F.col("before_n") + F.col("n"))

    wanted = F.lit(False)
    for p in probs.values():
        wanted = wanted | holds(low(p)) | holds(high(p))
    values = drill(df, keys, value, {"n": F.lit(1)}, lambda level: level.where(wanted), members)[-1]
    picks = []
    for name, p in probs.items():
        picks += [F.max(F.when(holds(r), F.col("low"))).alias(f"_{end}_{name}") for end, r in (("lo", low(p)), ("hi", high(p)))]
    found = values.groupBy(*keys).agg(F.max("all_n").alias("all_n"), *picks)
    return found.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (rank(p) - low(p))).alias(n)
        for n, p in probs.items()])


def distributed_row_number(df: DataFrame, group: list[str], order: list[Column], name: str = "rn",
                           size: str | None = None) -> DataFrame:
    """row_number() per group (and optionally the group size) without whole-group tasks.

    Rows are range-partitioned by (group, order), written once, numbered inside
    each sorted range and shifted by the counts of the ranges before it. A group
    that owns most rows is spread over as many ranges as its share asks for.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = (df.repartitionByRange(parts, *[F.col(g) for g in group], *order)
              .withColumn("_range", F.spark_partition_id()))
    stored = write_and_read(ranges, "ranges")
    keys = group or ["_one"]
    if not group:
        stored = stored.withColumn("_one", F.lit(1))
    counts = stored.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    offsets = counts.withColumn("_before", _before(keys, "_range", F.col("_rows")))
    if size:
        offsets = offsets.withColumn(size, F.sum("_rows").over(Window.partitionBy(*keys)))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return (stored.join(offsets.drop("_rows"), keys + ["_range"])
            .withColumn(name, (inside + F.col("_before")).cast("long"))
            .drop("_range", "_before", "_one"))


def suffix_counts(df: DataFrame, keys: list[str], value: str, measures: list[str]) -> DataFrame:
    """For each (key, value) row: the sum of each measure over strictly larger values.

    `df` holds one row per (key, value). Sums above a bin come from bin totals,
    sums above a value inside its bin from a window over that bin alone.
    """
    binned = df.withColumn("_bin", F.shiftright(value_bin(F.col(value)), FINE_BITS - 4))
    totals = binned.groupBy(*keys, "_bin").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    above = totals.select(*keys, "_bin", *[
        _before(keys, "_bin", F.col(f"_t_{m}"), descending=True).alias(f"_a_{m}") for m in measures])
    return (binned.join(above, keys + ["_bin"])
            .withColumns({f"above_{m}": F.col(f"_a_{m}")
                          + _before(keys + ["_bin"], value, F.col(m), descending=True)
                          for m in measures})
            .drop("_bin", *[f"_a_{m}" for m in measures]))

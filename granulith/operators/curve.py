"""Learning-curve analysis: collapsed points, the saturating fit, verdicts and export."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from granulith import constants as K
from granulith.session import settle


def collapsed(points: DataFrame, keys: list[str], y: str = "acc") -> DataFrame:
    """Repeats of one fraction as mean, spread and count."""
    return (points.where(F.col(y).isNotNull()).groupBy(*keys, "frac").agg(
        F.avg("n_train").alias("n"), F.avg(y).alias("y"), F.min(y).alias("lo"),
        F.max(y).alias("hi"), F.count("*").alias("reps")))


def _bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _candidate(c: Column) -> Column:
    """Least squares for one exponent, from a key's `_log` (log of n over the least n) and `_dy` (y less its mean)."""
    k = F.size("_log")

    def solved(x):
        return _bound(F.struct((_sum(x) / k).alias("mx"), _sum(F.zip_with(x, "_dy", lambda u, v: u * v)).alias("xy"),
                           _sum(F.transform(x, lambda u: u * u)).alias("xx")),
                      lambda t: _bound(t["xy"] / F.nullif(t["xx"] - k * t["mx"] * t["mx"], F.lit(0.0)), lambda slope: F.struct(
                          F.greatest(F.lit(0.0), F.col("_yy") - slope * t["xy"]).alias("sse"), c.alias("c"),
                          (F.col("_my") - slope * (t["mx"] + 1)).alias("a"), (-slope * F.pow("n_min", c)).alias("b"))))

    # n^-c over its largest value, less 1: no digits are lost where all n are alike
    return _bound(F.transform("_log", lambda v: F.expm1(-c * v)), solved)


def fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """y = a - b * n^-c per key: scan 196 exponents, least squares for a and b, lowest error wins.

    A key's collapsed points, one for each fraction measured, are one row, and the scan is an expression of that row: no
    exponent becomes a row, so nothing is shuffled or broadcast for them. A degenerate design (one size only) drops out
    as null; so does a key with a size that is not above 0.
    """
    first, last, count = K.CURVE_C
    point = F.when(F.col("n").isNotNull(), F.struct("n", "y"))
    whole = collapsed(points, keys).groupBy(*keys).agg(
        F.count("*").alias("_k"), F.max("y").alias("_ymax"), F.var_pop("y").alias("_yvar"), F.min("n").alias("n_min"),
        F.max("n").alias("n_max"), F.array_sort(F.collect_list(point)).alias("_p")).where("_k >= 3 and n_min > 0")
    whole = settle(whole, {"_my": _sum(F.col("_p.y")) / F.size("_p"), "_log": F.transform("_p", lambda p: F.ln(p["n"] / F.col("n_min")))})
    whole = settle(whole, {"_dy": F.transform("_p", lambda p: p["y"] - F.col("_my"))})
    whole = settle(whole, {"_yy": _sum(F.transform("_dy", lambda d: d * d))})
    scan = F.transform(F.sequence(F.lit(0), F.lit(count - 1)),
                       lambda i: _bound(F.lit(first) + i * F.lit((last - first) / (count - 1)), _candidate))
    usable = F.filter(scan, lambda f: (f["b"] > 0) & (f["a"] > F.col("_ymax") - 1e-9) & (f["a"] <= 1.0))
    best = settle(whole, {"f": F.array_min(usable)}).where("f is not null")
    ss_tot = F.col("_k") * F.col("_yvar")
    return best.select(*keys, "f.a", "f.b", "f.c", "f.sse", (F.col("f.a") < 0.99).alias("ceiling_identified"),
                       (1 - F.col("f.sse") / F.nullif(ss_tot, F.lit(0.0))).alias("r2"), "n_min", "n_max")


def project(fits: DataFrame, n: str) -> DataFrame:
    """Fitted accuracy at n particles; null for n <= 0."""
    return fits.withColumn("projected", F.when(
        F.col(n) > 0, F.col("a") - F.col("b") * F.pow(F.col(n).cast("double"), -F.col("c"))))


def verdict(runs: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """What doubling the labelled set is predicted to buy; `runs` has n_total per key."""
    at = lambda n: F.col("a") - F.col("b") * F.pow(n, -F.col("c"))
    n = F.col("n_total").cast("double")
    out = (runs.join(fits, keys, "left").withColumn("here", at(n))
           .withColumn("gain_doubling", (at(2 * n) - F.col("here")) * 100)
           .withColumn("headroom", (F.col("a") - F.col("here")) * 100))
    state = (F.when(F.col("gain_doubling").isNull(), "unknown").when(F.col("gain_doubling") >= 3, "climbing")
             .when(F.col("gain_doubling") >= 1, "flattening").otherwise("plateau"))
    return out.select(*keys, "n_total", state.alias("state"), "gain_doubling", "headroom", "here",
                      F.col("a").alias("ceiling"))


def instrument_gap(points: DataFrame, keys: list[str], gap_pts: float = 5.0) -> DataFrame:
    """Best and worst instrument at the largest training size; null unless two instruments."""
    last = points.where("acc_instrument is not null").groupBy(*keys, "instrument").agg(
        F.max(F.struct("n_train", (-F.col("draw")).alias("_d"), "acc_instrument")).alias("_l"))
    agg = last.groupBy(*keys).agg(
        F.count("*").alias("_k"),
        F.min(F.struct(F.col("_l.acc_instrument").alias("acc"), "instrument")).alias("_w"),
        F.max(F.col("_l.acc_instrument")).alias("_best")).where("_k >= 2")
    gap = (F.col("_best") - F.col("_w.acc")) * 100
    return agg.select(*keys, gap.alias("gap"), F.col("_w.instrument").alias("weakest"),
                      (gap >= gap_pts).alias("coverage_gap"))


def capacity(points: DataFrame, keys: list[str], underfit: float = 0.90, gap_pts: float = 15.0) -> DataFrame:
    """underfit / variance / balanced, at the largest size measured."""
    top = (points.where("acc_train is not null").groupBy(*keys).agg(
        F.max(F.struct("n_train", (-F.col("draw")).alias("_d"), "acc_train", "acc")).alias("_t")))
    gap = (F.col("_t.acc_train") - F.col("_t.acc")) * 100
    state = F.when(F.col("_t.acc_train") < underfit, "underfit").when(gap >= gap_pts, "variance").otherwise("balanced")
    return top.select(*keys, state.alias("state"), F.col("_t.acc_train").alias("acc_train"),
                      F.col("_t.acc").alias("acc_test"), gap.alias("gap"))


def export_table(points: DataFrame, by_instrument: DataFrame, instruments: list[str], recalls: DataFrame | None = None,
                 classes: list[str] = K.PATTERNS) -> DataFrame:
    """The curve as a flat export: one row per measured model, a column per instrument and one with the recall of each class.

    `recalls` (run_id, frac, draw, class, recall) holds what was measured; a class without held-out particles is empty.
    """
    key = ["run_id", "frac", "draw"]
    # a plain maximum per column is one hash aggregation; a pivot is two, and sorts
    of = lambda column, name, value: F.round(F.max(F.when(F.col(column) == name, F.col(value))), 5)
    named = by_instrument.groupBy(*key).agg(*[of("instrument", i, "acc_instrument").alias(f"acc_{i.replace(' ', '_')}") for i in instruments])
    out = (points.select(*key, "n_train", F.round("acc", 5).alias("held_out_accuracy"),
                         F.round("acc_train", 5).alias("train_accuracy")).join(named, key, "left")
           .withColumnsRenamed({"frac": "fraction_of_pool", "n_train": "particles_train"}))
    if recalls is None:
        return out
    per_class = (recalls.groupBy(*key).agg(*[of("class", c, "recall").alias(c) for c in classes])
                 .withColumnRenamed("frac", "fraction_of_pool"))
    return out.join(per_class, ["run_id", "fraction_of_pool", "draw"], "left")


def write_csv(table: DataFrame, path: str) -> None:
    """The export as CSV files with a header; missing measures are empty."""
    table.write.mode("overwrite").option("header", True).csv(path)


def keep_newest(runs: DataFrame, keys: list[str], ts: str, keep: int = K.HISTORY_KEEP,
                tie: str | None = None) -> DataFrame:
    """History retention. The small limit is applied before the shuffle as well as after it."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts), *([F.desc(tie)] if tie else []))
    return runs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def keep_snapshots(snaps: DataFrame, keys: list[str], ts: str, rows: str, keep: int = K.SNAPSHOT_KEEP) -> DataFrame:
    """The newest few snapshots plus the fullest one (the oldest of equally full ones)."""
    newest = keep_newest(snaps, keys, ts, keep)
    rest = [c for c in snaps.columns if c not in keys]
    full = (snaps.groupBy(*keys)
            .agg(F.max(F.struct(F.col(rows).alias("_r"), (-F.unix_micros(F.col(ts))).alias("_t"),
                                F.struct(*rest).alias("_row"))).alias("_f"))
            .select(*keys, "_f._row.*"))
    return newest.unionByName(full.select(*newest.columns)).distinct()

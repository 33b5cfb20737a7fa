"""Refitting the decision thresholds with leave-one-photo-out validation.

Each cut of the grid only needs how many solid and liquid rows lie at or above
it. Those counts per photo are small, and leaving a photo out is a subtraction
from the totals, so no photo is ever refitted row by row.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from granulith import constants as K
from granulith.functions import gates
from granulith.session import write_and_read

FIRST, LAST = K.GRID_PERCENT


def calibration_rows(labels: DataFrame, particles: DataFrame, stamp: str) -> DataFrame:
    """Labelled particles of fresh, classifiable photos whose class is known to the calibration."""
    fresh = particles.where((F.col("pipeline") == stamp) & F.col("classifiable"))
    named = labels.where(F.col("class").isin(K.CLASS_ORDER)).select(
        "image_id", F.col("label_id").alias("particle_id"), F.col("class").alias("cls"))
    return fresh.join(named, ["image_id", "particle_id"]).select(
        F.col("image_id").alias("photo"), "particle_id", "cls", "facet_frac", "diam_nm", "pattern_probs")


def fit_inputs(rows: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """(name, photo, p, y, current): each threshold with the sub-population it governs."""
    solid = F.col("cls").isin(K.PATTERNS).cast("int")
    named = gates.size_aware_pattern(thresholds)
    four = gates.has_probs() & (F.size("pattern_probs") >= 4)
    small = four & (F.col("diam_nm") < K.PATTERN_SMALL_NM)
    ff = F.col("facet_frac")
    parts = [("facet_thresh", F.lit(True), ff, solid),
             ("janus_min_solid", four & (named == "janus"), ff, (F.col("cls") == "janus").cast("int")),
             ("nopattern_solid_conf", four & (named == ""), ff, solid),
             ("stripe_small_min_conf", small, F.try_element_at("pattern_probs", F.lit(2)),
              (F.col("cls") == "stripe").cast("int")),
             ("janus_small_min_conf", small, F.try_element_at("pattern_probs", F.lit(1)),
              (F.col("cls") == "janus").cast("int"))]
    entries = F.array_compact(F.array(*[
        F.when(where, F.struct(F.lit(name).alias("name"), p.alias("p"), y.alias("y"),
                               F.lit(gates.threshold(thresholds, name)).alias("current")))
        for name, where, p, y in parts]))
    return rows.select("photo", F.explode(entries).alias("e")).select("photo", "e.*")


def highest_cut(p: Column) -> Column:
    """Largest cut (in hundredths) with p >= cut / 100, clamped; FIRST - 1 means below the grid."""
    c = F.floor(p * 100).cast("int")
    exact = F.when(p >= (c + 1) / 100.0, c + 1).when(p >= c / 100.0, c).otherwise(c - 1)
    return F.greatest(F.lit(FIRST - 1), F.least(F.lit(LAST), exact))


def cut_counts(inputs: DataFrame) -> DataFrame:
    """Per (name, photo, cut): rows at or above the cut by label, with the photo's totals."""
    y = F.col("y") == 1
    met = F.col("p") >= F.col("current")
    counts = (inputs.groupBy("name", "photo", highest_cut(F.col("p")).alias("cut"))
              .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"),
                   F.count_if(y & met).alias("cur_tp"), F.count_if(~y & ~met).alias("cur_tn")))
    zeros = (counts.groupBy("name", "photo").agg(F.count("*").alias("_k"))
             .select("name", "photo", F.explode(F.sequence(F.lit(FIRST - 1), F.lit(LAST))).alias("cut")))
    dense = zeros.join(counts, ["name", "photo", "cut"], "left").na.fill(0)
    one = Window.partitionBy("name", "photo")               # 92 rows
    down = one.orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)
    return (dense.select("name", "photo", "cut",
                         F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
                         F.sum("pos").over(one).alias("p_all"), F.sum("neg").over(one).alias("n_all"),
                         F.sum("cur_tp").over(one).alias("cur_tp"), F.sum("cur_tn").over(one).alias("cur_tn"))
            .where(F.col("cut") >= FIRST))


def balanced(tp: Column, fp: Column, pos: Column, neg: Column) -> Column:
    """Mean of the two per-class accuracies; null if a class is missing."""
    return 0.5 * (tp / F.nullif(pos, F.lit(0)) + (neg - fp) / F.nullif(neg, F.lit(0)))


def totals(cuts: DataFrame) -> DataFrame:
    return cuts.groupBy("name", "cut").agg(*[
        F.sum(c).alias(f"t_{c}") for c in ("tp", "fp", "p_all", "n_all")])


def best_cuts(cuts: DataFrame) -> DataFrame:
    """The lowest cut with the best balanced accuracy, per threshold."""
    score = balanced(F.col("t_tp"), F.col("t_fp"), F.col("t_p_all"), F.col("t_n_all"))
    scored = totals(cuts).withColumn("_s", score).where("_s is not null")
    return (scored.groupBy("name").agg(F.max(F.struct("_s", (-F.col("cut")).alias("_c"))).alias("_b"))
            .select("name", (-F.col("_b._c") / 100.0).alias("cut"), F.col("_b._s").alias("score")))


def leave_one_out(cuts: DataFrame) -> DataFrame:
    """Out-of-photo score of a refitted cut and of the one in force, per threshold.

    A photo counts only if it holds both classes and the remaining photos do too.
    """
    t = F.broadcast(totals(cuts))        # at most five thresholds times 91 cuts
    rest = cuts.join(t, ["name", "cut"])
    score = balanced(F.col("t_tp") - F.col("tp"), F.col("t_fp") - F.col("fp"),
                     F.col("t_p_all") - F.col("p_all"), F.col("t_n_all") - F.col("n_all"))
    own = balanced(F.col("tp"), F.col("fp"), F.col("p_all"), F.col("n_all"))
    cur = balanced(F.col("cur_tp"), F.col("n_all") - F.col("cur_tn"), F.col("p_all"), F.col("n_all"))
    per_photo = (rest.withColumns({"_s": score, "_own": own, "_cur": cur,
                                   "_w": F.col("p_all") + F.col("n_all")})
                 .groupBy("name", "photo").agg(
                     F.max(F.when(F.col("_s").isNotNull(),
                                  F.struct("_s", (-F.col("cut")).alias("_c"), "_own", "_cur"))).alias("_b"),
                     F.max("_w").alias("_w")))
    ok = F.col("_b").isNotNull() & F.col("_b._own").isNotNull()
    w = F.when(ok, F.col("_w"))
    agg = per_photo.groupBy("name").agg(
        F.count("*").alias("n_photos"), F.sum("_w").alias("n_rows"), F.sum(w).alias("_n"),
        F.sum(F.when(ok, F.col("_b._own") * F.col("_w"))).alias("_fit"),
        F.sum(F.when(ok, F.col("_b._cur") * F.col("_w"))).alias("_old"))
    enough = F.col("n_photos") >= K.CAL_MIN_PHOTOS
    return agg.select("name", "n_rows", "n_photos", F.when(enough, F.col("_fit") / F.col("_n")).alias("fit_score"),
                      F.when(enough, F.col("_old") / F.col("_n")).alias("current_score"))


def fit(rows: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """One report row per threshold; `value` is the cut to adopt or the one that stays."""
    # 455 rows per photo at most, used four times: written once instead of recounted
    cuts = write_and_read(cut_counts(fit_inputs(rows, thresholds)), "cuts")
    loo, best = leave_one_out(cuts), best_cuts(cuts)
    both = (cuts.where(F.col("cut") == FIRST).groupBy("name")
            .agg(F.sum("p_all").alias("_pos"), F.sum("n_all").alias("_neg")))
    names = rows.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(gates.threshold(thresholds, n)).alias("current"))
        for n in K.DEFAULT_THRESHOLDS])).alias("d")).select("d.*")
    whole = (loo.where("name = 'facet_thresh'")
             .select(F.col("n_rows").alias("_all_rows"), F.col("n_photos").alias("_all_photos")))
    out = (names.join(loo, "name", "left").join(best, "name", "left").join(both, "name", "left")
           .join(F.broadcast(whole), how="left"))         # a single row
    rows_ok = ((F.coalesce("_all_rows", F.lit(0)) >= K.CAL_MIN_PARTICLES)
               & (F.coalesce("_all_photos", F.lit(0)) >= K.CAL_MIN_PHOTOS))
    sub_ok = (F.col("name") == "facet_thresh") | (F.coalesce("n_rows", F.lit(0)) >= K.CAL_MIN_SUBSET)
    mixed = ~F.col("name").isin("stripe_small_min_conf", "janus_small_min_conf") | (
        (F.col("_pos") > 0) & (F.col("_neg") > 0))
    gain = F.col("fit_score") > F.col("current_score") + K.CAL_MIN_GAIN
    decision = (F.when(~rows_ok, "not_enough_data").when(~sub_ok | ~mixed, "too_few")
                .when(F.col("fit_score").isNull(), "no_spread")
                .when(F.col("cut").isNotNull() & gain, "adopted").otherwise("kept"))
    return (out.withColumn("decision", decision)
            .select("name", "current", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                    F.coalesce("n_photos", F.lit(0)).alias("n_photos"), "cut", "fit_score", "current_score",
                    "decision", F.when(F.col("decision") == "adopted", F.col("cut"))
                    .otherwise(F.col("current")).alias("value")))


def restamp(particles: DataFrame, thresholds: dict, stamp: str, new_stamp: str) -> DataFrame:
    """Re-decide fresh rows under new thresholds from their stored probabilities."""
    fresh = particles.where(F.col("pipeline") == stamp)
    return gates.reclassify(fresh, thresholds).withColumn("pipeline", F.lit(new_stamp))

"""Review queues ordered by uncertainty, verdicts, and what the verdicts say about the model."""

from pyspark.sql import DataFrame, functions as F

from granulith import constants as K
from granulith.functions import classes
from granulith.operators.ranking import distributed_row_number

KEY = ["image_id", "particle_id"]


def queue_rows(particles: DataFrame, labelled: DataFrame,
               facet_thresh: float = K.DEFAULT_THRESHOLDS["facet_thresh"]) -> DataFrame:
    """Particles the model has an opinion on that nobody has labelled yet."""
    rows = (particles.where("classifiable").withColumn("cls", classes.review_class()).where("cls <> ''")
            .select(*KEY, "cls", classes.confidence(facet_thresh).alias("conf"), "diam_nm"))
    return rows.join(labelled.select(*KEY), KEY, "left_anti")


def queue(rows: DataFrame) -> DataFrame:
    """Least confident first per class: rank from 0, page of 32, items in the queue."""
    ranked = distributed_row_number(
        rows, ["cls"], [F.col("conf"), F.col("image_id"), F.col("particle_id")], "_rn", size="n_items")
    return (ranked.withColumn("rank", F.col("_rn") - 1)
            .withColumn("page", F.floor(F.col("rank") / K.REVIEW_PAGE)).drop("_rn"))


def counts(particles: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per class: particles still to review and all of them."""
    seen = labelled.select(*KEY).distinct().withColumn("_done", F.lit(True))
    rows = (particles.where("classifiable").withColumn("cls", classes.review_class()).where("cls <> ''")
            .select(*KEY, "cls").join(seen, KEY, "left"))
    return rows.groupBy("cls").agg(F.count_if(F.col("_done").isNull()).alias("pending"),
                                   F.count("*").alias("every"))


def last_verdicts(verdicts: DataFrame) -> DataFrame:
    """The latest verdict per particle; submitting a page again changes nothing."""
    rest = [c for c in verdicts.columns if c not in KEY + ["seq"]]
    return (verdicts.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("_v"))
            .select(*KEY, "_v.*"))


def accepted(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Confirmed, corrected and the correction rate, over sets of particles."""
    v = last_verdicts(verdicts)
    wrong = F.col("cls") != F.col("model_cls")
    return v.groupBy(*keys).agg(F.count("*").alias("n_seen"), F.count_if(wrong).alias("n_fixed"))


def prefilled(rows: DataFrame, clicks: DataFrame) -> DataFrame:
    """A review opened again shows the user's own last answer where there is one."""
    own = clicks.select(*KEY, F.col("cls").alias("_own"))
    return rows.join(own, KEY, "left").withColumn("shown", F.coalesce("_own", "cls")).drop("_own")


def rank_note(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Correction rate in the least and most confident quarter (n // 4 from both ends, n >= 40)."""
    v = distributed_row_number(last_verdicts(verdicts), keys,
                               [F.col("rank"), F.col("image_id"), F.col("particle_id")], "_rn", size="_n")
    q = F.floor(F.col("_n") / 4)
    wrong = (F.col("cls") != F.col("model_cls")).cast("int")
    agg = v.where("_n >= 40").groupBy(*keys).agg(
        F.count("*").alias("n"),
        (100.0 * F.avg(F.when(F.col("_rn") <= q, wrong))).alias("first_pct"),
        (100.0 * F.avg(F.when(F.col("_rn") > F.col("_n") - q, wrong))).alias("last_pct"))
    return agg.withColumn("systematic", (F.col("last_pct") >= 15.0)
                          & (F.col("last_pct") >= 0.5 * F.col("first_pct")))


def photo_progress(verdicts: DataFrame, particles: DataFrame) -> DataFrame:
    """Per photo: reviewable, seen, corrected; error on its more confident half (n >= 20)."""
    v = distributed_row_number(last_verdicts(verdicts), ["image_id"],
                               [F.col("rank"), F.col("cls"), F.col("particle_id")], "_rn", size="_n")
    wrong = (F.col("cls") != F.col("model_cls")).cast("int")
    sure = (F.col("_n") >= 20) & (F.col("_rn") > F.floor(F.col("_n") / 2))
    seen = v.groupBy("image_id").agg(F.count("*").alias("n_seen"), F.sum(wrong).alias("n_fixed"),
                                     (100.0 * F.avg(F.when(sure, wrong))).alias("sure_wrong_pct"))
    total = (particles.where("classifiable").groupBy("image_id")
             .agg(F.count_if(classes.review_class() != "").alias("n_reviewable")))
    return (seen.join(total, "image_id", "left")
            .withColumn("flag", F.coalesce(F.col("sure_wrong_pct") >= 15.0, F.lit(False))))

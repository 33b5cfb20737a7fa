"""Training labels: effective view, layering, disagreements, summaries, fingerprints."""

from pyspark.sql import Column, DataFrame, functions as F

from granulith import constants as K
from granulith.functions import classes, gates
from granulith.session import join_lookup

KEY = ["image_id", "particle_id"]


def effective(particles: DataFrame, clicks: DataFrame, blanks: DataFrame) -> DataFrame:
    """The label each particle would be saved with: the model's answer, overruled by clicks."""
    offered = join_lookup(
        particles.where(F.col("classifiable") & ~F.col("excluded") & gates.measurable()),
        blanks.select("image_id"), ["image_id"], "left_anti")
    model = (offered.select(*KEY, F.when(~F.col("is_solid"), "undercooled")
                            .when(F.col("pattern") != "", F.col("pattern")).alias("_m"))
             .where("_m is not null"))
    both = model.join(clicks.select(*KEY, F.col("cls").alias("_c")), KEY, "full_outer")
    return (both.where("_c is null or _c <> 'exclude'")
            .select(*KEY, F.coalesce("_c", "_m").alias("cls"), F.col("_c").isNotNull().alias("from_user")))


def truth_layers(saved: DataFrame, clicks: DataFrame) -> DataFrame:
    """Saved labels with the current clicks laid on top, one row per particle."""
    return (saved.select(*KEY, F.col("cls").alias("_s"))
            .join(clicks.select(*KEY, F.col("cls").alias("_c")), KEY, "full_outer")
            .select(*KEY, F.coalesce("_c", "_s").alias("truth")))


def compared(truth: DataFrame, particles: DataFrame) -> DataFrame:
    """Every labelled particle with the model's class; `agree` treats exclude and excluded alike."""
    t, m = F.col("truth"), F.col("model")
    return (truth.join(particles.select(*KEY, classes.model_class().alias("model")), KEY)
            .withColumn("agree", (t == m) | ((t == "exclude") & (m == "excluded"))))


def agreement(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Checked / agreed counts, and the same without particles the model could not name."""
    agg = pairs.groupBy(*keys).agg(
        F.count("*").alias("checked"), F.count_if("agree").alias("agree"),
        F.count_if(~F.col("agree") & (F.col("model") == "solid")).alias("_nopat"))
    named = F.col("checked") - F.col("_nopat")
    return agg.select(*keys, "checked", "agree", (F.col("agree") / F.col("checked")).alias("share"),
                      named.alias("checked_named"),
                      F.coalesce(F.try_divide("agree", named), F.lit(0.0)).alias("share_named"))


def disagreement_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.where(~F.col("agree")).groupBy(*keys, "truth", "model").agg(F.count("*").alias("n"))


def crop_measurable(crops: DataFrame, particles: DataFrame) -> DataFrame:
    """Whether each training crop belongs to a measured particle, matched by float32 diameter.

    Used only where all particles of that diameter in the photo agree.
    """
    table = (particles.select("image_id", F.col("diam_nm").cast("float").alias("_d"),
                              gates.measurable().alias("_m"))
             .groupBy("image_id", "_d").agg(F.bool_and("_m").alias("_all"), F.bool_or("_m").alias("_any"))
             .where("_all = _any").drop("_any"))
    keyed = crops.withColumn("_d", F.col("diam_nm").cast("float"))
    return (join_lookup(keyed, table, ["image_id", "_d"], "left")
            .withColumn("measurable", F.coalesce("_all", F.lit(False)))
            .withColumn("known", F.col("_all").isNotNull()).drop("_all", "_d"))


def golden_train_conflicts(labels: DataFrame) -> DataFrame:
    """Photos present in both label sets."""
    return (labels.where("set_name = 'golden'").select("image_id")
            .intersect(labels.where("set_name = 'train'").select("image_id")))


def refuse_golden(new: DataFrame, golden: DataFrame) -> DataFrame:
    """Labels that may be saved for training: a golden photo is never trained on."""
    return join_lookup(new, golden.select("image_id").distinct(), ["image_id"], "left_anti")


def instrument_golden(detector: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(detector)), F.lit("")), F.lit("no nameplate"))


def instrument_curve(detector: Column, readable: Column) -> Column:
    return (F.when(~readable, "unknown")
            .otherwise(F.coalesce(F.nullif(F.trim(detector), F.lit("")), F.lit("no nameplate"))))


def signature(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprint of a label set, whatever its size and order.

    Each label's text "id:class" ("id:x" for an excluded one) is hashed; the count
    and the sums of four parts of the hashes are hashed again. The sums combine
    before the shuffle, so no list of a photo's labels is ever built.
    """
    entry = F.md5(F.concat(F.col("particle_id").cast("string"), F.lit(":"),
                           F.when(F.col("cls") == "exclude", "x").otherwise(F.col("cls"))))
    part = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long")
    sums = labels.select(*keys, entry.alias("_h")).groupBy(*keys).agg(
        F.count("*").alias("n_labels"), *[F.sum(part(i)).alias(f"_s{i}") for i in range(4)])
    text = F.concat_ws(":", "n_labels", *[f"_s{i}" for i in range(4)])
    return sums.select(*keys, "n_labels", F.substring(F.sha1(text), 1, 16).alias("signature"))


def training_state(images: DataFrame, saved: DataFrame, current: DataFrame) -> DataFrame:
    """none-in-set "new", "saved" or "edited" per image, by comparing fingerprints."""
    s = saved.select("image_id", F.col("signature").alias("_s"))
    c = current.select("image_id", F.col("signature").alias("_c"))
    return (images.select("image_id", "classifiable").join(s, "image_id", "left").join(c, "image_id", "left")
            .select("image_id", F.when(F.col("_s").isNull(), "new")
                    .when(~F.col("classifiable") | (F.col("_s") == F.col("_c")), "saved")
                    .otherwise("edited").alias("state")))


def restore_report(saved: DataFrame, particles: DataFrame) -> DataFrame:
    """Per photo: saved labels that still point at a particle, and those that do not."""
    known = particles.select(*KEY).withColumn("_k", F.lit(True))
    return (saved.select(*KEY).join(known, KEY, "left").groupBy("image_id").agg(
        F.count("*").alias("n_saved"), F.count_if(F.col("_k").isNotNull()).alias("n_matched"),
        F.count_if(F.col("_k").isNull()).alias("n_missing")))


def missing_ids(saved: DataFrame, particles: DataFrame) -> DataFrame:
    return saved.select(*KEY).subtract(particles.select(*KEY))


def training_summary(labels: DataFrame) -> DataFrame:
    """Rows, photos and class weight per pattern class; trainable needs 60 rows and two classes."""
    per_photo = (labels.where(F.col("class").isin(K.PATTERNS))
                 .groupBy("set_name", "class", "image_id").agg(F.count("*").alias("_n")))
    agg = per_photo.groupBy("set_name", "class").agg(
        F.sum("_n").alias("n"), F.count("*").alias("n_photos"))
    totals = agg.groupBy("set_name").agg(F.sum("n").alias("_total"), F.count("*").alias("_k"))
    return (join_lookup(agg, totals, ["set_name"])
            .select("set_name", "class", "n", "n_photos",
                    (F.col("_total") / (F.lit(len(K.PATTERNS)) * F.col("n"))).alias("weight"),
                    ((F.col("_total") >= K.TRAIN_MIN_ROWS) & (F.col("_k") >= 2)).alias("trainable")))


def train_readiness(labels: DataFrame) -> DataFrame:
    per_photo = labels.groupBy("set_name", "image_id").agg(F.count("*").alias("_n"))
    return (per_photo.groupBy("set_name").agg(F.count("*").alias("n_photos"))
            .withColumn("ready", F.col("n_photos") >= K.TRAIN_MIN_PHOTOS))


def model_vs_effective(particles: DataFrame, eff: DataFrame, clicks: DataFrame, keys: list[str]) -> DataFrame:
    """Per class: what the model says, what would be saved, hand exclusions and rescued dim rows."""
    model = (particles.select(*KEY, classes.model_class().alias("cls")))
    counted = model.groupBy(*keys, "cls").agg(F.count("*").alias("n_model"))
    final = (eff.where(F.col("cls").isin(K.CLASS_ORDER)).groupBy(*keys, "cls")
             .agg(F.count("*").alias("n_effective")))
    dropped = model.where("cls = 'excluded'").select(*KEY)
    rescued = (clicks.where("cls <> 'exclude'").join(dropped, KEY, "left_semi")
               .groupBy(*keys, "cls").agg(F.count("*").alias("n_rescued")))
    gone = (clicks.where("cls = 'exclude'").groupBy(*keys).agg(F.count("*").alias("n_user_excluded"))
            .withColumn("cls", F.lit("excluded")))
    out = counted.join(final, keys + ["cls"], "full_outer")
    out = out.join(rescued, keys + ["cls"], "full_outer").join(gone, keys + ["cls"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (out.select(*keys, "cls", zero("n_model"), zero("n_effective"), zero("n_rescued"),
                       zero("n_user_excluded"))
            .withColumn("difference", F.col("n_effective") - F.col("n_model")))

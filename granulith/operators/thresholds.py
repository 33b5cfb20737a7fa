"""Thresholds in force, the pipeline stamp and the freshness of stored analyses."""

from pyspark.sql import Column, DataFrame, functions as F

from granulith import constants as K
from granulith.session import join_lookup


def overlay(scopes: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Defaults per scope, replaced by stored text values that are numbers strictly inside (0, 1).

    `stored` holds (keys, name, value); unknown names are ignored.
    """
    defaults = F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(v).alias("default_value"))
        for n, v in K.DEFAULT_THRESHOLDS.items()]))
    base = scopes.select(*keys, defaults.alias("d")).select(*keys, "d.name", "d.default_value")
    number = F.col("value").try_cast("double")
    return (base.join(stored, keys + ["name"], "left")
            .select(*keys, "name", "default_value",
                    F.coalesce(F.when((number > 0) & (number < 1), number), F.col("default_value")).alias("value"),
                    F.col("value").isNotNull().alias("fitted")))


def pipeline_stamp(weights: list[Column], thresholds: dict[str, float]) -> Column:
    """Short identity of the rules, the model files and the thresholds in force."""
    parts = [F.lit(f"v{K.PIPELINE_VERSION}"), *weights]
    parts += [F.lit(f"{name}={value:.4f}") for name, value in sorted(thresholds.items())]
    return F.concat(F.lit(f"{K.PIPELINE_VERSION}."), F.substring(F.md5(F.concat_ws("|", *parts)), 1, 10))


def freshness(images: DataFrame, analysed: DataFrame, stamp: str) -> DataFrame:
    """none / current / stale per image; `analysed` is the set of analysed image ids."""
    done = analysed.select("image_id").withColumn("_done", F.lit(True))
    return (images.join(done, "image_id", "left")
            .select("image_id", F.when(F.col("_done").isNull(), "none")
                    .when(F.col("pipeline") == stamp, "current").otherwise("stale").alias("state")))

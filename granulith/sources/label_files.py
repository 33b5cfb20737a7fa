"""Hand-label documents: one JSON object per photo (or per slice of one) with a `labels` array."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from granulith import schema
from granulith.operators.labels import refuse_golden
from granulith.streaming import parts

_FIELDS = ["class", "source", "cx", "cy", "diam_nm", "model_cls", "conf", "rank", "n_items"]


def read_labels(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per label; rows whose id is not an integer are skipped."""
    docs = spark.read.schema(schema.LABEL_DOCUMENT).option("multiLine", multi_line).json(path)
    rows = docs.select("stem", "detector", "nm_per_px",
                       F.try_to_timestamp("confirmed", F.lit("yyyy-MM-dd HH:mm")).alias("confirmed"),
                       F.explode("labels").alias("l"))
    return (rows.select("stem", "detector", "nm_per_px", "confirmed",
                        F.col("l.id").try_cast("long").alias("label_id"), *[f"l.{f}" for f in _FIELDS])
            .where("label_id is not null"))


def read_golden(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Labels usable as ground truth: the centroid must be known."""
    return read_labels(spark, path, multi_line).where("cx is not null and cy is not null")


def split_excluded(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class labels and the ids that were marked "exclude"."""
    return labels.where("class <> 'exclude'"), labels.where("class = 'exclude'").select("stem", "label_id")


def label_documents(labels: DataFrame, slice_ids: int = 10000) -> DataFrame:
    """Label rows (stem, detector, nm_per_px, confirmed, label_id, ...) back to JSON documents.

    A photo with very many labels becomes several documents of bounded size.
    """
    row = F.struct(F.col("label_id").cast("string").alias("id"), *[f for f in _FIELDS if f in labels.columns])
    part = F.pmod(F.xxhash64("label_id"), F.col("_slices"))
    sizes = (labels.groupBy("stem", F.pmod(F.xxhash64("label_id"), F.lit(64)).alias("_s")).agg(F.count("*").alias("_n"))
             .groupBy("stem").agg((F.floor(F.sum("_n") / slice_ids) + 1).alias("_slices")))
    from granulith.session import join_lookup
    sized = join_lookup(labels, sizes, ["stem"]).withColumn("_part", part)
    return (sized.groupBy("stem", "_part").agg(
        F.min("detector").alias("detector"), F.min("nm_per_px").alias("nm_per_px"),
        F.date_format(F.max("confirmed"), "yyyy-MM-dd HH:mm").alias("confirmed"),
        F.array_sort(F.collect_list(row)).alias("labels")).drop("_part"))


def save_confirmed(labels: DataFrame, golden: DataFrame, path: str) -> None:
    """Upsert confirmed photos: what they held before is void, golden photos are refused.

    `labels` and `golden` carry image_id. A save is a part of a table (see `streaming.parts`), so the folders grow with the
    saves, not with the photos.
    """
    number = parts.next_batch(labels.sparkSession, path)
    rows = refuse_golden(labels, golden).withColumn("version", F.lit(number).cast("long"))
    parts.put(rows, rows, path, number)


def read_confirmed(spark: SparkSession, path: str) -> DataFrame | None:
    """The labels of every photo's newest save, or None if nothing is saved."""
    rows = parts.current(spark, path)
    return None if rows is None else rows.drop("version")

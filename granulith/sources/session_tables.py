"""Stored analyses: load with orphan removal, export, guarded overwrite with snapshots."""

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from granulith import constants as K, schema
from granulith.operators.curve import keep_snapshots
from granulith.session import delete_folder, folders, join_lookup

BUCKETS = 256
#: The stored form that is written, and those that can be read; others are from a later program.
VERSION = 3
READABLE = (1, 2, 3)
#: What a field means where an older store does not have it; fields without an entry are null then.
MISSING = {"edge_cut": 0.0, "perim_px": 0.0, "bright": 0.0, "pattern": "", "excluded": False, "unclassified": False, "user_solid": False}


def load_particles(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    """Stored particles of known images, of every readable version in the store, brought to the present form.

    Fields that came later get their meaning (a perimeter of 0 is one to be filled in, see `regions.backfill_perimeter`),
    and rows are held to the present floor in pixels, which older stores may lie below. Folders of other versions are not
    opened, nor are images dropped for them.
    """
    stored = (spark.read.schema(schema.PARTICLES + ", version int").option("basePath", path).parquet(path)
              .where(F.col("version").isin(*READABLE)))
    whole = stored.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in MISSING.items()} | {
        "pattern_probs": F.coalesce("pattern_probs", F.array().cast("array<double>"))})
    floored = whole.where(F.col("diam_px") >= K.MIN_COUNT_DIAM_PX).drop("version")
    return join_lookup(floored, images.select("image_id"), ["image_id"], "left_semi")


def save_particles(particles: DataFrame, path: str, version: int = VERSION) -> None:
    """Store by image bucket: a bounded number of folders, pruned when an image is read."""
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(BUCKETS)).cast("int")
    # rebalancing merges small writes and splits a bucket that one huge image fills
    (particles.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite")
     .partitionBy("bucket").parquet(f"{path}/version={version}"))


#: Rows of one exported file: a compressed file is read by one task.
EXPORT_ROWS = 1_000_000


def export_csv(particles: DataFrame, path: str, by_image: bool = False) -> None:
    """Per-particle CSV, compressed, in files of bounded size; arrays are written as text joined by spaces."""
    flat = particles.select(*[
        F.concat_ws(" ", F.transform(F.col(c), lambda v: v.cast("string"))).alias(c) if t.startswith("array")
        else F.col(c) for c, t in particles.dtypes])
    w = flat.write.mode("overwrite").option("header", True).option("compression", "gzip").option("maxRecordsPerFile", EXPORT_ROWS)
    (w.partitionBy("image_id") if by_image else w).csv(path)


LEDGER = "store string, version int, ts timestamp, n_rows long, state string"


def _ledger(spark: SparkSession, root: str) -> list:
    """One row per save of the store; a store has few, so they are read on the driver."""
    try:
        return sorted(spark.read.schema(LEDGER).parquet(f"{root}/ledger").collect(), key=lambda r: r.version)
    except AnalysisException:
        return []


def guarded_save(df: DataFrame, root: str) -> int:
    """Save a new version of a store and return the version in force.

    An empty result never replaces a version that has rows. A save that loses rows leaves the version before as a
    snapshot; the newest four snapshots and the fullest one are kept. Other versions leave the disk, once the ledger that
    no longer lists them is written; one that an interrupted save left behind goes with the next.
    """
    spark = df.sparkSession
    saves = _ledger(spark, root)
    now = next((r for r in saves if r.state == "in force"), None)
    version = 1 + max((r.version for r in saves), default=0)
    path = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    n = spark.read.parquet(path).count()
    if n == 0 and now is not None and now.n_rows:
        delete_folder(spark, path)
        return now.version
    rows = [(root, r.version, r.ts, r.n_rows, "snapshot" if r.n_rows > n else "past") if r is now else tuple(r) for r in saves]
    snapshots = spark.createDataFrame([r for r in rows if r[4] == "snapshot"], LEDGER)
    kept = {r.version for r in keep_snapshots(snapshots, ["store"], "ts", "n_rows").collect()}
    rows = [r for r in rows if r[1] in kept] + [(root, version, datetime.datetime.now(), n, "in force")]
    spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger")
    listed = {"ledger", *(f"version={r[1]}" for r in rows)}
    for old in folders(spark, root):
        if old not in listed:
            delete_folder(spark, f"{root}/{old}")
    return version


def stored_versions(spark: SparkSession, root: str) -> DataFrame:
    """version, state and row count of the version in force and the snapshots kept, counted in the stored files."""
    listed = spark.read.schema(LEDGER).parquet(f"{root}/ledger").select("version", "state")
    counted = spark.read.option("basePath", root).parquet(f"{root}/version=*").groupBy("version").agg(F.count("*").alias("n_rows"))
    return listed.join(counted.withColumn("version", F.col("version").cast("int")), "version", "left").select(
        "version", "state", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def shrinking_saves(saves: DataFrame) -> DataFrame:
    """Saves (store, ts, n_rows, previous_rows) that lost rows: the version before is snapshotted."""
    return (saves.where(F.col("n_rows") < F.col("previous_rows"))
            .select("store", "ts", F.col("previous_rows").alias("n_rows")))

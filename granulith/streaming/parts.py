"""A stored table that grows by parts: every batch appends what it brings, and nothing else is rewritten.

    rows/batch_id=N     rows of batch N, with their `version`
    index/batch_id=N    image_id, version, n_rows, folded: the images batch N brings

An image's rows are those of its newest version; rows of one version may arrive in several batches. What is superseded
stays until a part is mostly superseded: then the next batch takes over what is left of it (`folded` entries stand for all
rows of the image stored before), and a later one deletes it. A batch only reads what batches before it wrote, so a replay
writes the same again.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from granulith.session import delete_folder

KEY = "image_id"
#: Every so many batches the index is read for parts to fold or delete.
FOLD_EVERY = 8


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:                                     # nothing is stored yet
        return None


def _current(entries: DataFrame) -> DataFrame:
    """The entries with `current`: the newest version's, from the last time on that they were folded."""
    since = F.when(F.col("folded"), F.col("batch_id")).otherwise(-1)
    newest = entries.groupBy(KEY).agg(F.max(F.struct("version", since.alias("since"))).alias("_newest"))
    return (entries.join(newest, KEY)
            .withColumn("current", (F.col("version") == F.col("_newest.version")) & (F.col("batch_id") >= F.col("_newest.since")))
            .drop("_newest"))


def _parts(entries: DataFrame) -> list:
    """For each part its entries and rows, and how many of them are current: a few numbers, for the driver."""
    now = F.col("current")
    return _current(entries).groupBy("batch_id").agg(
        F.count("*").alias("entries"), F.count_if(now).alias("live"), F.sum("n_rows").alias("n_rows"),
        F.sum(F.when(now, F.col("n_rows")).otherwise(0)).alias("live_rows")).collect()


def _of(rows: DataFrame, entries: DataFrame, batches: list[int]) -> DataFrame:
    """Current rows of some parts; other folders are not opened."""
    live = _current(entries).where("current").select(KEY, "version", "batch_id")
    return rows.where(F.col("batch_id").isin(batches)).join(live, [KEY, "version", "batch_id"], "left_semi")


def put(rows: DataFrame, images: DataFrame, root: str, batch_id: int, fold_every: int = FOLD_EVERY) -> None:
    """Store a batch: `rows` with image_id and version, and the (image_id, version) pairs it brings, also those without rows."""
    spark = rows.sparkSession
    index = _read(spark, f"{root}/index")
    known = None if index is None else index.where(F.col("batch_id") < batch_id)
    brought = images.select(KEY, "version").distinct()
    folded = []
    if known is not None and batch_id % fold_every == fold_every - 1:
        before = _parts(known)
        for part in before:
            if part.live == 0:                                    # by batches that are done: no replay needs it
                delete_folder(spark, f"{root}/rows/batch_id={part.batch_id}")
                delete_folder(spark, f"{root}/index/batch_id={part.batch_id}")
        gone = [part.batch_id for part in before if part.live == 0]
        known = known.where(~F.col("batch_id").isin(gone)) if gone else known
        coming = known.unionByName(brought.select(KEY, "version", F.lit(0).cast("long").alias("n_rows"), F.lit(False).alias("folded"),
                                                  F.lit(batch_id).alias("batch_id")))
        folded = [part.batch_id for part in _parts(coming) if part.batch_id < batch_id and part.live and 2 * part.live_rows < part.n_rows]
    new, entry = rows, brought.withColumn("folded", F.lit(False))
    if folded:
        left = _of(_read(spark, f"{root}/rows"), coming, folded).drop("batch_id")
        new = new.unionByName(left, allowMissingColumns=True)
        moved = _current(coming).where("current").where(F.col("batch_id").isin(folded)).select(KEY, "version").distinct()
        # an image that is partly in a folded part moves whole, as its folded entry stands for all stored before
        others = _current(coming).where("current").where((F.col("batch_id") < batch_id) & ~F.col("batch_id").isin(folded))
        rest = others.join(moved, [KEY, "version"], "left_semi").select(KEY, "version", "batch_id")
        new = new.unionByName(_read(spark, f"{root}/rows").join(rest, [KEY, "version", "batch_id"], "left_semi").drop("batch_id"),
                              allowMissingColumns=True)
        entry = entry.unionByName(moved.withColumn("folded", F.lit(True)))
    path = f"{root}/rows/batch_id={batch_id}"
    # as many files as the rows need, an image's rows together
    new.hint("rebalance", KEY).write.mode("overwrite").parquet(path)
    counted = spark.read.schema(new.schema).parquet(path).groupBy(KEY, "version").agg(F.count("*").alias("n_rows"))
    # the last entry of an image stands for folded rows and for new ones of the same version
    entry = entry.groupBy(KEY, "version").agg(F.bool_or("folded").alias("folded")).join(counted, [KEY, "version"], "left")
    (entry.select(KEY, "version", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "folded")
     .write.mode("overwrite").parquet(f"{root}/index/batch_id={batch_id}"))


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows in force, or None if nothing is stored. Parts that are wholly current are read as they are."""
    index, rows = _read(spark, f"{root}/index"), _read(spark, f"{root}/rows")
    if index is None or rows is None:
        return None
    parts = _parts(index)
    whole = [p.batch_id for p in parts if p.live == p.entries]
    partly = [p.batch_id for p in parts if 0 < p.live < p.entries]
    return rows.where(F.col("batch_id").isin(whole)).unionByName(_of(rows, index, partly)).drop("batch_id")


def next_batch(spark: SparkSession, root: str) -> int:
    """The number of the next batch, where no stream gives one. A batch that was interrupted has no entries; its number comes again."""
    index = _read(spark, f"{root}/index")
    last = None if index is None else index.agg(F.max("batch_id")).first()[0]
    return 0 if last is None else int(last) + 1


def newest(spark: SparkSession, root: str) -> DataFrame:
    """(image_id, version): the newest version stored of every image."""
    index = _read(spark, f"{root}/index")
    if index is None:
        return spark.createDataFrame([], f"{KEY} long, version long")
    return index.groupBy(KEY).agg(F.max("version").alias("version"))

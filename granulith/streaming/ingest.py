"""Incremental ingest of newly analysed photos with Structured Streaming.

Photos arrive as particle files in folders `delivery=N`; a photo that comes again in a later delivery replaces what was
there. Two streams read the same inbox, each with its own checkpoint: `start` stores the decided particles, `run_stats`
keeps each photo's size statistics, as sums of what each batch brought.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from granulith import constants as K, schema as S
from granulith.functions import gates
from granulith.session import write_and_read
from granulith.streaming import parts


def decide(particles: DataFrame) -> DataFrame:
    """`counted` (the count floors), classifiability, classes and the measured flag of raw particle rows."""
    known = particles.withColumns({"counted": F.coalesce(gates.count_floor(), F.lit(False)), "classifiable": gates.classifiable()})
    return gates.reclassify(known).withColumn("measured", gates.measurable())


def _inbox(spark: SparkSession, schema: T.StructType, source: str, files_per_batch: int, options: dict) -> DataFrame:
    reader = spark.readStream.schema(T.StructType(list(schema.fields)).add("delivery", "long")).option("maxFilesPerTrigger", files_per_batch)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.parquet(source)


def _run(stream: DataFrame, write, checkpoint: str, mode: str) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(write).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def start(spark: SparkSession, schema: T.StructType, source: str, table: str, checkpoint: str,
          prepare=decide, files_per_batch: int = 1000, fold_every: int = parts.FOLD_EVERY, **options: str) -> StreamingQuery:
    """Store everything new under `source`, then stop; call again for the next round.

    `prepare` decides raw rows and keeps `delivery`. A batch writes its own particles and one index row for each photo, see
    `parts`; photos left without a counted particle are emptied too. Batch numbers name the parts, so one table belongs to
    one checkpoint.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        decided = prepare(batch).withColumnRenamed("delivery", "version")
        parts.put(decided.where("counted").drop("counted"), decided, table, batch_id, fold_every)

    return _run(_inbox(spark, schema, source, files_per_batch, options), write, checkpoint, "append")


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest delivery of every photo; no rows if nothing is stored."""
    rows = parts.current(spark, table)
    return spark.createDataFrame([], S.PARTICLES + ", version long") if rows is None else rows


# --- corrections ---------------------------------------------------------------------
def save_overrides(overrides: DataFrame, table: str, path: str) -> None:
    """Append corrections, each with the delivery of its photo that it was made on (-1: not stored yet)."""
    now = parts.newest(overrides.sparkSession, table)
    (overrides.join(now, "image_id", "left").withColumn("version", F.coalesce("version", F.lit(-1)))
     .write.mode("append").parquet(path))


def current_overrides(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Corrections in force. A newer delivery of a photo voids those made before it: its particle ids mean something else.

    Nothing is rewritten for that; the index of deliveries decides. Without a store of corrections there are none.
    """
    stored = parts._read(spark, path)
    if stored is None:
        return spark.createDataFrame([], S.OVERRIDES)
    now = parts.newest(spark, table).withColumnRenamed("version", "_now")
    return (stored.join(now, "image_id", "left").where(F.col("version") == F.coalesce("_now", F.lit(-1))).drop("version", "_now"))


# --- running statistics ---------------------------------------------------------------
_COUNTS = ["count_total", "count_measured", "n_solid", "n_flat", "n_excluded", *[f"n_{p}" for p in K.PATTERNS]]
_FLAGS = ["classifiable", "has_patterns"]
STATS = ("image_id long, delivery long, classifiable boolean, has_patterns boolean, " + ", ".join(f"{c} long" for c in _COUNTS)
         + ", mean_nm double, std_nm double, min_nm double, max_nm double")


def partial_stats(decided: DataFrame) -> DataFrame:
    """Size and class statistics of decided rows, per photo and delivery, in a form that adds up.

    A photo without a counted row has its row too. The order statistics are not among them: they don't add up.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    counted, judged, solid = yes(F.col("counted")), yes(F.col("classifiable")), yes(F.col("is_solid"))
    flat = judged & ~solid & ~yes(F.col("excluded")) & ~yes(F.col("unclassified"))
    size = F.when(counted & yes(F.col("measured")) & ~F.isnan("diam_nm"), F.col("diam_nm"))
    n = lambda c: F.count_if(counted & c)
    return decided.groupBy("image_id", "delivery").agg(
        F.bool_or(counted & judged).alias("classifiable"),
        F.bool_or(counted & judged & yes(gates.has_probs())).alias("has_patterns"),
        F.count_if(counted).alias("count_total"), n(yes(F.col("measured"))).alias("count_measured"), n(judged & solid).alias("n_solid"),
        n(flat).alias("n_flat"), n(yes(F.col("excluded"))).alias("n_excluded"),
        *[n(solid & yes(F.col("pattern") == p)).alias(f"n_{p}") for p in K.PATTERNS],
        F.count(size).alias("_n"), F.avg(size).alias("_mean"), (F.var_pop(size) * F.count(size)).alias("_m2"),
        F.min(size).alias("min_nm"), F.max(size).alias("max_nm"))


def merged_stats(partials: DataFrame) -> DataFrame:
    """One row per photo from the partial statistics of its newest delivery; squared deviations merge without cancellation."""
    own = Window.partitionBy("image_id")
    mean = F.sum(F.col("_n") * F.col("_mean")).over(own) / F.nullif(F.sum("_n").over(own), F.lit(0))
    apart = F.col("_mean") - F.col("mean_nm")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = partials.withColumn("mean_nm", mean).groupBy("image_id").agg(
        F.max("delivery").alias("delivery"), *[F.bool_or(c).alias(c) for c in _FLAGS], *[F.sum(c).alias(c) for c in _COUNTS],
        zero(F.max("mean_nm")).alias("mean_nm"),
        zero(F.sqrt(F.sum(F.col("_m2") + F.col("_n") * apart * apart) / F.nullif(F.sum("_n"), F.lit(0)))).alias("std_nm"),
        zero(F.min("min_nm")).alias("min_nm"), zero(F.max("max_nm")).alias("max_nm"))
    judged = lambda c: F.when(F.col("classifiable"), F.col(c)).alias(c)
    return out.select(*[judged(c) if c in ("n_solid", "n_flat") else c for c in out.columns])


def run_stats(spark: SparkSession, schema: T.StructType, source: str, table: str, checkpoint: str,
              prepare=decide, files_per_batch: int = 1000, fold_every: int = parts.FOLD_EVERY, **options: str) -> StreamingQuery:
    """Bring the statistics of every photo under `source` up to date in `table`, then stop; a later call goes on from the
    checkpoint. A batch adds one row for each photo it brings; a newer delivery voids a photo's rows, see `parts`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # written once: each action on the batch would sum its particles again
        rows = write_and_read(partial_stats(prepare(batch)).withColumnRenamed("delivery", "version"), "stats")
        parts.put(rows, rows, table, batch_id, fold_every)

    return _run(_inbox(spark, schema, source, files_per_batch, options), write, checkpoint, "append")


def stats_now(spark: SparkSession, table: str) -> DataFrame:
    """The newest statistics of every photo; no rows if there are none."""
    rows = parts.current(spark, table)
    return spark.createDataFrame([], STATS) if rows is None else merged_stats(rows.withColumnRenamed("version", "delivery"))

"""Session helpers: shared scratch folder, written intermediate tables, size-checked joins."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(master: str, app: str = "granulith", shuffle_partitions: int | None = None,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use the submitted one."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         # recording the Python call site of every expression costs more than building the plan
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .config("spark.driver.memory", memory))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return tune(b.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the long decision projections need.

    Generated methods above 8000 bytes of bytecode are never compiled by the
    JVM's optimiser, so such a stage is better split into per-operator code.
    A skewed join is split even where the next step then needs one more shuffle.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def settle(df: DataFrame, columns: dict) -> DataFrame:
    """Add columns whose expressions must not be copied into later filters.

    Catalyst replaces a filtered column by its definition when it pushes the
    filter down, which multiplies a long rule chain. Generator output is left
    alone, so the chain is computed once per row and filtered by value.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for written intermediates; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/granulith-{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a stored folder, in whatever file system its path names; nothing happens if it is gone already."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a stored folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


#: Rows of one partition after they have multiplied.
SPREAD_ROWS = 1 << 18


def spread(df: DataFrame, *keys: str, each: int | None = None) -> DataFrame:
    """Rows that are about to become many, dealt out by `keys` over all shuffle partitions.

    With `each`, the rows that one becomes, partitions are added until one holds about SPREAD_ROWS: what a task keeps of them
    then follows neither the input nor the session's number. The rows are counted for it, so give a plain table.
    A number that is given is kept: the adaptive planner would merge partitions by what they hold before the rows multiply.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if each:
        parts = max(parts, -(-df.count() * each // SPREAD_ROWS))
    return df.repartition(parts, *keys)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write once to the shared folder and read the files back.

    Unlike a cached block, the files survive the loss of any executor, and a
    non-deterministic step (a partition number) is evaluated exactly once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_lookup(fact: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a fact table to a lookup that holds one row per key (any rows for semi and anti joins).

    A plain equi-join, whatever the sizes: the adaptive planner sends the lookup around only if its measured size is
    within the session's broadcast limit, and splits a key that owns a large part of the facts (see `tune`). It can split
    only where both sides were shuffled for the join. A lookup that was grouped by the keys would go in as it is, so the
    keys' hash joins too: the grouped rows, one per key, are then shuffled once more.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("a lookup join keeps the fact side")
    own = F.hash(*keys)
    return fact.withColumn("_own", own).join(lookup.withColumn("_own", own), [*keys, "_own"], how).drop("_own")

"""Filing a whole photo library by what its file names say."""

from pyspark.sql import DataFrame, functions as F

from granulith.functions import naming as N
from granulith.operators.ranking import distributed_row_number
from granulith.session import join_lookup, write_and_read


def parsed(photos: DataFrame) -> DataFrame:
    """(photo columns, prefix, num, name, key, known) from a `stem` column."""
    return N.read_once(photos)


def _commonest(df: DataFrame, keys: list[str], value: str, path: str, name: str) -> DataFrame:
    """Most frequent value per key; ties go to the value seen on the smallest path."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(path).alias("_p"))
    return counted.groupBy(*keys).agg(
        F.min(F.struct((-F.col("_n")).alias("_a"), F.col("_p"), F.col(value).alias("_v"))).alias("_b")
    ).select(*keys, F.col("_b._v").alias(name))


def plan(photos: DataFrame, path: str) -> DataFrame:
    """Sample and group folder per photo.

    Numbers take the code most of their photos spell out; a number without one
    borrows the library's only code. A leftover group needs two photos.
    """
    p = write_and_read(parsed(photos), "names")               # read five times below
    coded = p.where("num is not null and prefix is not null")
    codes = _commonest(coded, ["num"], "prefix", path, "_code")
    lone = (coded.groupBy("prefix").agg(F.count("*").alias("_n"))
            .agg(F.when(F.count("*") == 1, F.min("prefix")).alias("_lone")))
    grouped = p.where("num is not null and key is not null")
    shared = grouped.groupBy("num", "key").agg(F.count("*").alias("_members"))
    spelled = _commonest(grouped, ["key"], "name", path, "_spelling")
    out = join_lookup(p, codes, ["num"], "left")
    out = join_lookup(out, shared, ["num", "key"], "left")
    out = join_lookup(out, spelled, ["key"], "left")
    out = out.crossJoin(F.broadcast(lone))                    # one row
    code = F.coalesce("_code", "_lone")
    sample = F.when(F.col("num").isNull(), N.UNSORTED).when(
        code.isNotNull(), F.concat(code, F.lit(" - "), F.col("num"))).otherwise(F.col("num"))
    folder = F.when(F.col("num").isNotNull() & F.col("key").isNotNull()
                    & (F.col("known") | (F.col("_members") > 1)), F.col("_spelling"))
    return out.select(*photos.columns, sample.alias("sample"), folder.alias("folder"))


def outline(planned: DataFrame) -> DataFrame:
    """Photo counts per sample and folder, with the sample and grand totals (null level names)."""
    named = planned.withColumn("folder", F.coalesce("folder", F.lit("")))
    return (named.rollup("sample", "folder").agg(F.count("*").alias("n"), F.grouping_id().alias("level")))


def export_names(photos: DataFrame, word: str) -> DataFrame:
    """Export name per photo (image_id, stem, title), never two alike: " 2", " 3" are appended."""
    base = N.safe_name(F.concat(F.col("title"), F.lit(f" {word}"), N.image_number(F.col("stem"), F.col("title"))))
    r = distributed_row_number(photos.withColumn("base", base), ["base"], [F.col("image_id")], "_rn")
    return r.select("image_id", F.when(F.col("_rn") == 1, F.col("base")).otherwise(
        F.concat("base", F.lit(" "), F.col("_rn").cast("string"))).alias("export_name"))

"""The photo library as a flat table (path, name, trail): select, search, import, heal, remove."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from granulith import constants as K
from granulith.functions.naming import fold
from granulith.functions.text import common_prefix
from granulith.session import join_lookup, write_and_read


def under_folder(library: DataFrame, folder: list[str]) -> DataFrame:
    """Every photo beneath a folder, once."""
    want = F.array(*[F.lit(f) for f in folder])
    return library.where(F.slice("trail", 1, len(folder)) == want).dropDuplicates(["path"])


def search(library: DataFrame, text: str) -> DataFrame:
    """Photos whose name and folders hold every word of the text, whatever case or marks."""
    hay = fold(F.concat_ws(" ", F.col("name"), F.array_join("trail", "  /  ")))
    terms = F.split(fold(F.lit(text)), " ")
    return library.where((fold(F.lit(text)) != "") & F.forall(terms, lambda t: F.contains(hay, t)))


def import_new(library: DataFrame, found: DataFrame) -> DataFrame:
    """Found files that are not in the library yet, each once."""
    return found.dropDuplicates(["path"]).join(library.select("path"), "path", "left_anti")


def remove(library: DataFrame, paths: DataFrame | None = None, folder: list[str] | None = None) -> DataFrame:
    """Drop photos by path, or a folder with all that is beneath it; analyses are kept elsewhere."""
    out = library
    if paths is not None:
        out = out.join(paths.select("path"), "path", "left_anti")
    if folder:
        want = F.array(*[F.lit(f) for f in folder])
        out = out.where(~(F.slice("trail", 1, len(folder)) == want))
    return out


def trailing_number(stem: Column) -> Column:
    return F.nullif(F.regexp_extract(stem, r"(\d+)\s*$", 1), F.lit(""))


def _file_parts(df: DataFrame) -> DataFrame:
    stem = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return df.withColumns({
        "_dir": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "_stem": stem,
        "_ext": F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))}).withColumn("_num", trailing_number(F.col("_stem")))


_ORDER = ["_stem", "path"]


def _nearest(keys: list[str], first: list, value: Column) -> Column:
    """The last value that is not null among the rows before, in the given order."""
    w = Window.partitionBy(*keys).orderBy(*first).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(w)


def _carried(stored: DataFrame, keys: list[str]) -> DataFrame:
    """For each range of a folder that lies in several: the two free files before the range and the two after it.

    Ranges tell their first and last two free files, so a folder's window has a few rows for each of its ranges.
    """
    ranges = stored.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    spans = ranges.withColumn("_k", F.count("*").over(Window.partitionBy(*keys))).where("_k > 1").select(*keys, "_range")
    inside, down = Window.partitionBy(*keys, "_range"), [F.desc(c) for c in _ORDER]
    ends = (stored.where("_free").join(spans, [*keys, "_range"], "left_semi")
            .withColumns({"_up": F.row_number().over(inside.orderBy(*_ORDER)), "_down": F.row_number().over(inside.orderBy(*down))})
            .where("_up <= 2 or _down <= 2"))
    whole, file = Window.partitionBy(*keys).orderBy("_range", *_ORDER), F.struct(*_ORDER)
    ends = ends.select(*keys, "_range", *_ORDER, F.struct(file, F.lag(file).over(whole)).alias("_back"),
                       F.struct(file, F.lead(file).over(whole)).alias("_ahead"))
    both = spans.unionByName(ends, allowMissingColumns=True)                # a range's own row has no file
    own = F.col("path").isNotNull()
    both = both.withColumns({"_b": _nearest(keys, ["_range", own, *_ORDER], F.col("_back")),
                             "_a": _nearest(keys, [F.desc("_range"), own, *down], F.col("_ahead"))})
    files = F.explode(F.array("_b.col1", "_b.col2", "_a.col1", "_a.col2"))
    return (both.where(~own).select(*keys, "_range", files.alias("_f")).where("_f is not null")
            .select(*keys, "_range", "_f._stem", "_f.path", F.lit(True).alias("_free")))


def _between(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are not `_free`, with the two free files before (`_b`) and after (`_a`) them in the order of the stems.

    Rows are sorted over ranges, so that a folder of any size is split.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = write_and_read(rows.repartitionByRange(parts, *keys, *_ORDER).withColumn("_range", F.spark_partition_id()), "names")
    group, file = [*keys, "_range"], F.when(F.col("_free"), F.struct(*_ORDER))
    out = stored.unionByName(_carried(stored, keys))
    for name, order in (("_b", [*_ORDER, "_free"]), ("_a", [F.desc(c) for c in (*_ORDER, "_free")])):
        out = out.withColumn("_one", _nearest(group, order, file))
        out = out.withColumn(name, _nearest(group, order, F.when(F.col("_free"), F.struct(file.alias("near"), F.col("_one").alias("next"))))).drop("_one")
    return out.where(~F.col("_free"))


def find_renamed(missing: DataFrame, present: DataFrame, claimed: DataFrame) -> DataFrame:
    """New path of each missing file: same folder, extension and trailing number, and the
    single file that shares the longest name start (over 3 characters).

    In the order of the names the longest start is shared with a neighbour, and a second file shares it only if the
    neighbour on the other side, or the one behind, does. Every file is one row, two if it ends on a number.
    """
    key = ["_dir", "_ext", "_num"]
    # a missing file with a number only meets files with that number; one without meets all
    lost = _file_parts(missing).withColumn("_num", F.coalesce("_num", F.lit("")))
    free = _file_parts(present.join(claimed.select("path"), "path", "left_anti"))
    free = free.where(F.col("_ext").isin(K.IMAGE_EXTENSIONS)).withColumn("_num", F.explode(F.array_compact(F.array(F.lit(""), F.col("_num")))))
    free = free.join(lost.select(*key).distinct(), key, "left_semi")
    columns = [*key, *_ORDER]
    rows = _between(free.select(*columns, F.lit(True).alias("_free")).unionByName(lost.select(*columns, F.lit(False).alias("_free"))), key)
    sides = [F.col(c) for c in ("_b.near", "_b.next", "_a.near", "_a.next")]
    shared = F.array(*[F.struct(F.when(f.isNotNull(), F.length(common_prefix(F.col("_stem"), f["_stem"]))).alias("n"),
                                f["path"].alias("path")) for f in sides])
    best = F.array_max(F.transform("_shared", lambda x: x["n"]))
    hits = F.filter("_shared", lambda x: x["n"] == F.col("_best"))
    return (rows.withColumn("_shared", shared).withColumn("_best", best).withColumn("_hits", hits)
            .where((F.col("_best") > 3) & (F.size("_hits") == 1))
            .select(F.col("path").alias("old_path"), F.col("_hits")[0]["path"].alias("new_path")))


def apply_renames(store: DataFrame, renames: DataFrame, known: DataFrame) -> DataFrame:
    """Re-key a store by path and keep only rows of known photos."""
    r = renames.select(F.col("old_path").alias("path"), F.col("new_path").alias("_new"))
    moved = (join_lookup(store, r, ["path"], "left")
             .withColumn("path", F.coalesce("_new", "path")).drop("_new"))
    return join_lookup(moved, known.select("path").distinct(), ["path"], "left_semi")

"""The library tree as JSON in, flat rows (path, name, trail) out and back."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def _node_type(depth: int) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in ("type", "name", "path")]
    if depth:
        fields.append(T.StructField("children", T.ArrayType(_node_type(depth - 1))))
    return T.StructType(fields)


def _depth(spark: SparkSession, path: str) -> int:
    """Levels of folders in the deepest document: open brackets outside of quoted text."""
    quoted = r'"(?:[^"\\\\]|\\\\.)*"'
    marks = F.split(F.regexp_replace(F.regexp_replace("value", quoted, ""), r"[^\[\]]", ""), "")
    level = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, m: F.struct(
        (a["now"] + F.when(m == "[", 1).when(m == "]", -1).otherwise(0)).alias("now"),
        F.greatest(a["most"], a["now"] + F.when(m == "[", 1).otherwise(0)).alias("most")))
    return max(0, (spark.read.text(path).agg(F.max(level["most"])).first()[0] or 0) - 1)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Flatten folder documents of any depth; the trail lists the folders from the top."""
    depth = _depth(spark, path)
    tree = T.StructType([T.StructField("tree", T.ArrayType(_node_type(depth)))])
    level = (spark.read.schema(tree).json(path)
             .select(F.explode("tree").alias("n"), F.array().cast("array<string>").alias("trail")))
    found = []
    for i in range(depth + 1):
        found.append(level.where("n.type = 'image'").select("n.path", "n.name", "trail"))
        if i < depth:
            folders = level.where("n.type <> 'image'")
            level = folders.select(F.explode("n.children").alias("c"),
                                   F.concat("trail", F.array("n.name")).alias("trail")).withColumnRenamed("c", "n")
    return reduce(DataFrame.unionByName, found)


def library_documents(library: DataFrame) -> DataFrame:
    """One single-branch document per photo: folders merge again by trail when read."""
    node = F.to_json(F.struct(F.lit("image").alias("type"), "path", "name"))
    text = F.aggregate(F.reverse("trail"), node, lambda acc, f: F.concat(
        F.lit('{"type":"folder","name":'), F.to_json(F.array(f)).substr(F.lit(2), F.length(F.to_json(F.array(f))) - 2),
        F.lit(',"children":['), acc, F.lit("]}")))
    return library.select(F.concat(F.lit('{"tree":['), text, F.lit("]}")).alias("value"))


def count_images(library: DataFrame) -> DataFrame:
    """Photos per top folder."""
    return library.groupBy(F.coalesce(F.try_element_at("trail", F.lit(1)), F.lit("")).alias("folder")).agg(
        F.count("*").alias("n_images"))

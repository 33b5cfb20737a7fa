"""Image inventory of a folder tree; file contents are never read."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from granulith import constants as K


def inventory(spark: SparkSession, *folders: str) -> DataFrame:
    """path, modified and size of every image beneath the folders, each once."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders))
             .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")))
    return only_images(found.withColumn("path", F.regexp_replace("path", "^file:/+", "/")))


def place(files: DataFrame, root: str) -> None:
    """Write a small file under `root` for every path of a table; it holds its own path."""
    def run(batches):
        import posixpath

        import pyarrow as pa
        from pyarrow import fs
        for batch in batches:
            store, top = fs.FileSystem.from_uri(root)
            for path in batch.column(0).to_pylist():
                name = f"{top}/{path.lstrip('/')}"
                store.create_dir(posixpath.dirname(name), recursive=True)
                with store.open_output_stream(name) as out:
                    out.write(path.encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    files.select("path").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def only_images(files: DataFrame) -> DataFrame:
    """Rows whose path has an image extension, each path once."""
    pattern = r"(?i)\.(" + "|".join(K.IMAGE_EXTENSIONS) + ")$"
    return files.where(F.col("path").rlike(pattern)).dropDuplicates(["path"])

"""Connected components of an edge table by union-find in partitions and alternating star contraction across them."""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from granulith.session import join_lookup, write_and_read


def _unite(batches):
    """Edges of a partition, replaced by an edge from each node to the smallest node it is united with."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    def flush():
        rows = [(x, root(x)) for x in list(parent)]
        rows = [(x, r) for x, r in rows if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())],
                                          names=["v", "m"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = root(a), root(b)
            parent[max(a, b)] = parent.setdefault(min(a, b), min(a, b))
        if len(parent) > 1 << 20:
            yield flush()
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), long and not null; component is the smallest node it reaches.

    Each round hangs nodes onto smaller ones (large star, then small star), with a minimum per node that is combined
    before the shuffle, and joins that split at run time, so a node with very many edges is no single task's work. Rounds are written to the shared
    folder; their number grows with the logarithm of the longest chain. No edges give no rows.
    """
    now = write_and_read(edges.select("a", "b").where("a <> b").mapInArrow(_unite, "v long, m long").distinct(), "components")
    while True:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).union(now.select("m", "v"))
        low = both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = join_lookup(both.where("w > u"), low, ["u"]).select(F.col("w").alias("v"), F.col("low").alias("m"))
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = join_lookup(large, least, ["v"]).select(F.inline(F.array(
            F.struct("v", F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))))
        now = write_and_read(small.where("v <> m").distinct(), "components")
        # done once no node hangs on two, and none that others hang on hangs on another
        twice = now.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        chain = now.select(F.col("m").alias("v")).join(now.select("v"), "v", "left_semi").limit(1)
        if not twice.select("v").union(chain).take(1):
            break
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).union(
        now.select("m", F.col("m").alias("c")).distinct())

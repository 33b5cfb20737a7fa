"""Importance resampling of documents towards the word runs of a target, drawn by a distributed quickselect.

A text's features are its runs of one and two words, hashed into buckets. A bucket's gain says how much more often it
occurs in the target than in the corpus; a text's weight is the mean gain of its features. Gumbel noise, fixed by the id,
turns the largest weights into a draw without replacement: the k highest noisy scores are drawn.

The k-th key is found without sorting: random pivot keys cut the candidates, exact counts below, at and above each pivot
say where the k-th lies, and only the part between two pivots goes on. Only the drawn rows are ever sorted.
"""

import random
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from granulith.llm import flat
from granulith.session import write_and_read

BUCKETS = 10_000
#: Longer words are hashed one by one.
SHORT = 64
PIVOTS = 15
#: Copies of one key that are unfolded at a time.
COPIES = 4096
KEY = ["neg_score", "no_id", "doc_id", "n_words", "n_features", "weight"]


def _step(crc: np.ndarray) -> np.ndarray:
    """A CRC register after eight more zero bits."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (crc & np.uint32(1)))
    return crc


class Crc:
    """CRC-32 of many short stretches of bytes at once."""

    def __init__(self):
        self.table = _step(np.arange(256, dtype=np.uint32))
        by_byte = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        shifts = [by_byte]
        for _ in range(SHORT):
            shifts.append(self.table[shifts[-1] & 255] ^ (shifts[-1] >> np.uint32(8)))
        self.shifts = np.stack(shifts).reshape(-1)              # [length, byte of the register, its value]

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        order = np.argsort(np.minimum(SHORT + 1, size).astype(np.uint8), kind="stable")[::-1]
        at, longest = start[order], np.minimum(size[order], SHORT)
        crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
        for p in range(int(longest[0]) if len(order) else 0):
            n = len(order) - int(np.searchsorted(longest[::-1], p, "right"))
            c = crc[:n]
            crc[:n] = self.table[(c ^ data[at[:n] + p]) & 255] ^ (c >> np.uint32(8))
        out = np.empty_like(crc)
        out[order] = ~crc
        for i in np.flatnonzero(size > SHORT):
            out[i] = zlib.crc32(data[start[i]: end[i]])
        return out

    def pairs(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
        """CRC of every word, one space and the word after it, from the words' own: CRCs of joined stretches add up once
        the first is moved past the second."""
        if len(words) < 2:
            return np.zeros(0, np.uint32)
        first = ~words[:-1]
        first = ~(self.table[(first ^ np.uint32(32)) & 255] ^ (first >> np.uint32(8)))
        size = (end - start)[1:]
        row = np.minimum(size, SHORT) * 1024
        moved = (self.shifts[row + (first & 255)] ^ self.shifts[row + 256 + ((first >> np.uint32(8)) & 255)]
                 ^ self.shifts[row + 512 + ((first >> np.uint32(16)) & 255)] ^ self.shifts[row + 768 + (first >> np.uint32(24))])
        out = moved ^ words[1:]
        for i in np.flatnonzero(size > SHORT):
            out[i] = zlib.crc32(data[start[i + 1]: end[i + 1]], int(first[i]))
        return out


def _features(block: flat.Block, table: np.ndarray, crc: Crc, buckets: int) -> tuple[flat.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block, buckets of each word and of each word with the next, and whether that next one is in its text."""
    w = flat.Words(block, table)
    one = crc.words(w.bytes, w.start, w.end)
    two = crc.pairs(w.bytes, w.start, w.end, one)
    joined = np.ones(len(two), bool)
    cuts = w.at[1:-1]
    joined[cuts[(cuts > 0) & (cuts < len(w))] - 1] = False
    return w, one % buckets, two % buckets, joined


def bucket_counts(docs: DataFrame, column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all whole texts in each bucket; buckets without any are absent. Null texts have none."""
    def count(batches):
        table, crc, n = flat.letters_table(), Crc(), np.zeros(buckets, np.int64)
        for block in flat.blocks(batches, column):
            _, one, two, joined = _features(block, table, crc, buckets)
            n += np.bincount(one, minlength=buckets) + np.bincount(two[joined], minlength=buckets)
        at = np.flatnonzero(n)
        yield flat.records(["bucket", "n"], [at, n[at]])

    found = flat.in_small_batches(docs.select(column)).mapInArrow(count, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket: 1000 times the logarithm of its share in the target over its share in docs, each with one
    feature added, rounded down. As many numbers come to the driver as there are buckets."""
    def counts(df):
        out = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, buckets=buckets).collect():
            out[r.bucket] = r.n
        return out

    s, t = counts(docs), counts(target)
    ratio = (t + 1).astype(float) * float(s.sum() + buckets) / ((s + 1).astype(float) * float(t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, from the id alone; all rows without an id get the same."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    u = (h.cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def score(docs: DataFrame, gain: np.ndarray, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document, from its whole text (null: empty, weight 0)."""
    buckets = len(gain)

    def weigh(batches):
        table, crc = flat.letters_table(), Crc()
        for block in flat.blocks(batches):
            w, one, two, joined = _features(block, table, crc, buckets)
            each = gain[one]
            each[:-1] += np.where(joined, gain[two], 0)
            n = w.counts()
            features = n + np.maximum(n - 1, 0)
            mean = np.where(features > 0, flat.sums(each, w.at) // np.maximum(features, 1), 0)
            yield flat.records(["doc_id", "n_words", "n_features", "weight"], [block.column("doc_id"), n.astype(np.int64), features.astype(np.int64), mean])

    id_type = dict(docs.dtypes)["doc_id"]
    out = flat.in_small_batches(docs.select("doc_id", "text")).mapInArrow(weigh, f"doc_id {id_type}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(seed))


def _key() -> Column:
    return F.struct(*KEY)


def _literal(key, schema) -> Column:
    return F.struct(*[F.lit(key[n]).cast(schema[n].dataType).alias(n) for n in KEY])


def kth_key(keys: DataFrame, k: int, seed: int = 7, pivots: int = PIVOTS):
    """The row of KEY columns that holds the k-th place (from 1) of `keys`, whose `copies` say how often each key counts.

    Each round takes random keys of what is left, counts below and at each exactly, and keeps what lies between the two
    pivots around the k-th place, written, so that a round reads a small part of the one before. The driver sees pivots
    and counts only.
    """
    rnd, left, schema = random.Random(seed), keys, keys.schema
    order = lambda r: tuple(0 if r[c] is None else r[c] for c in KEY)
    while True:
        draws = [F.min_by(_key(), F.xxhash64(F.lit(rnd.getrandbits(62)), *KEY)).alias(f"p{j}") for j in range(pivots)]
        found = {order(p): p for p in left.agg(*draws).first()}
        picked = [found[o] for o in sorted(found)]
        counts = left.agg(*[F.coalesce(F.sum(F.when(cond, F.col("copies"))), F.lit(0)).alias(f"{name}{j}")
                            for j, p in enumerate(picked) for name, cond in (("below", _key() < _literal(p, schema)), ("at", _key() == _literal(p, schema)))]).first()
        low = high = None
        passed = 0
        for j, p in enumerate(picked):
            below, at = counts[f"below{j}"], counts[f"at{j}"]
            if k <= below:
                high = p
                break
            if k <= below + at:
                return p
            low, passed = p, below + at
        between = [c for c in (low and _key() > _literal(low, schema), high and _key() < _literal(high, schema)) if c is not None]
        left, k = write_and_read(left.where(reduce(Column.__and__, between)), "quickselect"), k - passed


def _ranked(winners: DataFrame) -> DataFrame:
    """winners with `before`, the copies ahead of each key: ranges of the order, summed apart and shifted by those before."""
    parts = int(winners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = write_and_read(winners.repartitionByRange(parts, *KEY).withColumn("_range", F.spark_partition_id()), "winners")
    totals = ranges.groupBy("_range").agg(F.sum("copies").alias("_n"))           # a row for each range
    ahead = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("copies").over(Window.partitionBy("_range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1))
    return (ranges.join(totals.select("_range", F.coalesce(ahead, F.lit(0)).alias("_ahead")), "_range")
            .withColumn("before", F.col("_ahead") + F.coalesce(inside, F.lit(0))).drop("_range", "_ahead"))


def draw(scored: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of `scored`.

    Of the N rows with at least min_words words, the floor(percent * N / 100) highest scores are drawn and ranked from 1;
    ties go to the smaller doc_id, rows without an id last. rank is null for the others. Rows alike in all columns count
    apart and take neighbouring ranks. An empty table, or too few rows for a draw, gives no ranks.
    """
    rows = scored.withColumns({"neg_score": -F.col("score"), "no_id": F.col("doc_id").isNull(), "able": F.col("n_words") >= min_words})
    keys = write_and_read(rows.groupBy(*KEY, "score", "able").agg(F.count("*").alias("copies")), "keys")
    able = keys.where("able")
    k = (able.agg(F.sum("copies")).first()[0] or 0) * percent // 100
    if k == 0:
        placed = keys.withColumn("before", F.lit(None).cast("long"))
    else:
        last = _literal(kth_key(able, k, seed), keys.schema)
        drawn = F.col("able") & (_key() <= last)
        placed = _ranked(keys.where(drawn)).unionByName(keys.where(~drawn), allowMissingColumns=True)
    # copies of a key unfold in blocks, so that no array grows with them
    blocks = placed.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES)))).withColumn(
        "_i", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("copies") - F.col("_b") * COPIES))))
    rank = F.col("before") + F.col("_b") * COPIES + F.col("_i")
    return blocks.select("doc_id", "n_features", "weight", "score", F.when(rank <= k, rank).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """`draw` of docs (doc_id, text), weighed towards the texts of `target`.

    Null and empty texts have no features and weight 0; repeated rows are rows of their own; other columns are left out,
    so their names can't clash. An empty target or corpus counts nothing and is smoothed like any other.
    """
    return draw(score(docs, gains(docs, target, buckets), seed), percent, min_words, seed)

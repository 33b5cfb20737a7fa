"""Hard negatives of anchor vectors by the threshold algorithm over sorted lists of components.

Rows are dealt into parts of bounded size by a hash of themselves, and every anchor visits every part. In a part each
dimension has its rows sorted by component. An anchor reads those lists from the end its own sign prefers, a stretch at a
time; a row met for the first time is scored in full. What the lists have not shown yet scores at most the threshold, the
anchor's product with the next components; once that is strictly below the worst kept score of every window (or below the
window itself), no unseen row can enter, not even by a tie. Parts' answers are merged, a few rows an anchor and part.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from granulith.llm import flat
from granulith.session import write_and_read

#: Rows of a part, about.
PART_ROWS = 8192
#: Places that the first stretch reads of every list; each further stretch reads as many as all before it.
FIRST_STRETCH = 32
#: Larger components would overflow a score of 64 bits.
LARGEST = float(1 << 20)
EXACT = float(1 << 53)


class Lists:
    """Rows of one part and one number of dimensions, and their order in each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order].astype(float)
        self.order = np.argsort(self.x, axis=0, kind="stable").T.astype(np.int32).copy()
        self.largest = float(np.abs(x).max(initial=0))

    def own(self, vec_id: int, label: int, a: np.ndarray) -> np.ndarray:
        """Places of the anchor's own row."""
        lo, hi = np.searchsorted(self.ids, [vec_id, vec_id + 1])
        return np.array([i for i in range(lo, hi) if self.labels[i] == label and np.array_equal(self.x[i], a)], np.int64)

    def visit(self, a: np.ndarray, take) -> None:
        """Hand rows and their scores to `take`, best components first, until it says that none below the threshold counts."""
        rows = len(self.ids)
        exact = self.largest * float(np.abs(a).max(initial=0)) * max(1, len(a)) < EXACT
        x, a = (self.x, a.astype(float)) if exact else (self.x.astype(np.int64), a.astype(np.int64))
        dims = np.flatnonzero(a)
        if not len(dims):                                         # every row scores 0
            take(np.arange(rows), np.zeros(rows, np.int64), None)
            return
        up, down = self.order[dims[a[dims] < 0]], self.order[dims[a[dims] > 0]]
        signed = np.concatenate([dims[a[dims] < 0], dims[a[dims] > 0]])
        seen, depth, stretch = np.zeros(rows, bool), 0, FIRST_STRETCH
        while depth < rows:
            to = min(rows, depth + stretch)
            met = np.zeros(rows, bool)
            met[up[:, depth:to]] = True
            met[down[:, rows - to: rows - depth]] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            threshold = None
            if to < rows:
                nearest = np.concatenate([up[:, to], down[:, rows - to - 1]])
                threshold = int((x[nearest, signed] * a[signed]).sum())
            if take(new, (x[new] @ a).astype(np.int64), threshold):
                return
            depth, stretch = to, to


class Best:
    """The k highest scores within [low, high], ties by the smaller id."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = np.ones(len(scores), bool) if self.low is None else (scores >= self.low) & (scores <= self.high)
        if len(self.scores) == self.k:
            ok &= scores >= self.scores[-1]
        if ok.any():
            s, i = np.append(self.scores, scores[ok]), np.append(self.ids, ids[ok])
            best = np.lexsort((i, -s))[: self.k]
            self.scores, self.ids = s[best], i[best]

    def closed(self, threshold: int) -> bool:
        if self.low is not None and (threshold < self.low or self.low > self.high):
            return True
        return len(self.scores) == self.k and threshold < self.scores[-1]


def _positives(lists: Lists, anchor: dict, k: int) -> list[tuple]:
    """(anchor, score, vec_id): the k best other rows of the anchor's label in this part."""
    best, own = Best(k), lists.own(anchor["vec_id"], anchor["label"], anchor["q"])

    def take(rows, scores, threshold):
        ok = (lists.labels[rows] == anchor["label"]) & ~np.isin(rows, own)
        best.add(scores[ok], lists.ids[rows[ok]])
        return threshold is not None and best.closed(threshold)

    lists.visit(anchor["q"], take)
    return [(anchor["anchor"], s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())]


def _negatives(lists: Lists, anchor: dict, k: int, low: int, high: int) -> list[tuple]:
    """(anchor, place, anchor_id, positive_id, positive_score, score, vec_id): for each positive of the anchor, the k best
    rows of other labels whose score is between low and high percent of the positive's."""
    windows = [Best(k, -(-low * p["score"] // 100), high * p["score"] // 100) for p in anchor["positives"]]

    def take(rows, scores, threshold):
        ok = lists.labels[rows] != anchor["label"]
        scores, ids = scores[ok], lists.ids[rows[ok]]
        for w in windows:
            w.add(scores, ids)
        return threshold is not None and all(w.closed(threshold) for w in windows)

    lists.visit(anchor["q"], take)
    return [(anchor["anchor"], p["place"], anchor["vec_id"], p["vec_id"], p["score"], s, i)
            for p, w in zip(anchor["positives"], windows) for s, i in zip(w.scores.tolist(), w.ids.tolist())]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(rows: DataFrame, anchors: DataFrame, parts: int, answer, schema: str) -> DataFrame:
    """answer(lists, anchor) for each anchor and part. A part's rows reach its task first, then anchors stream past."""
    kept = [c for c in anchors.columns if c not in ("vec_id", "label", "q")]
    types = dict(anchors.dtypes)
    held = rows.select(F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "vec_id", "label", "q",
                       *[F.lit(None).cast(types[c]).alias(c) for c in kept])
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "vec_id", "label", "q", *kept)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        part, gathered, lists = None, [], {}
        for batch in batches:
            mark = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                piece = batch.slice(lo, hi - lo)
                if part != mark[lo] // 2:
                    part, gathered, lists = mark[lo] // 2, [], {}
                if mark[lo] % 2 == 0:
                    gathered.append(piece)
                    continue
                if gathered:
                    table = pa.Table.from_batches(gathered).combine_chunks()
                    size = np.array(pc.list_value_length(table.column("q")))
                    for d in np.unique(size):
                        own = table.filter(pa.array(size == d)).combine_chunks()
                        q = own.column("q").combine_chunks()
                        lists[int(d)] = Lists(own.column("vec_id").to_numpy(), own.column("label").to_numpy(), _matrix(q))
                    gathered = []
                out = []
                for anchor in piece.to_pylist():
                    anchor["q"] = np.array(anchor["q"], np.int64)
                    if (own := lists.get(len(anchor["q"]))) is not None:
                        out += answer(own, anchor)
                if out:
                    yield flat.records(names, [np.array(c, np.int64) for c in zip(*out)])

    dealt = held.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "kind")
    return flat.in_small_batches(dealt).mapInArrow(run, schema)


def _first(df: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The k best rows per key, numbered; each task keeps its own k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def usable(vector: str, scale: int) -> Column:
    """Scaled components, rounded down; null for a null vector or one with a null, non-finite or too large component."""
    ok = F.forall(vector, lambda x: F.coalesce((F.abs(x) <= LARGEST) & ~F.isnan(x), F.lit(False)))
    return F.when(ok, F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("int")))


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         vector: str = "embedding", scale: int = 256, part_rows: int = PART_ROWS) -> DataFrame:
    """Hard negatives of every anchor and positive.

    vectors: vec_id, label and an array of components, which count as floor(scale * x). The anchors are the rows that meet
    the condition; their positives are the first `positives` other rows of their label, and for each of these the result
    holds the first `negatives` rows of other labels with low * positive_score <= 100 * score <= high * positive_score:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Scores are exact integer inner products,
    higher ones first, ties by smaller vec_id.

    Rows with a null vec_id, label or vector, or a component that is null, not finite or beyond 2**20, take no part; rows
    alike in all three columns count once; others that share a vec_id are rows of their own. Vectors meet only vectors of
    their own length. A negative positive_score leaves no window and no rows; an empty table gives none.
    """
    q = usable(vector, scale)
    rows = write_and_read(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"),
                                         F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
                          .where("vec_id is not null and label is not null and q is not null").dropDuplicates(["vec_id", "label", "q"]), "vectors")
    parts = max(1, -(-rows.count() // part_rows))
    asked = write_and_read(rows.where("is_anchor").select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "q"), "anchors")
    rows = rows.drop("is_anchor")
    near = _search(rows, asked, parts, lambda lists, a: _positives(lists, a, positives), "anchor long, score long, vec_id long")
    near = _first(near, ["anchor"], positives, "place")
    windows = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"))
    asked = write_and_read(asked.join(windows, "anchor"), "windows")
    found = _search(rows, asked, parts, lambda lists, a: _negatives(lists, a, negatives, low, high),
                    "anchor long, place long, anchor_id long, positive_id long, positive_score long, score long, vec_id long")
    return _first(found, ["anchor", "place"], negatives, "rank").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

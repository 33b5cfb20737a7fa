"""Toxicity classifier whose scores are held still under swaps of identity terms.

A logistic model over the words of a text. Besides the labels it is fitted to counterfactuals: in every labelled
sentence that names a group, the group's term is exchanged for each other term of its list, and the squared change of
the score is penalised, so that the mention of a group alone does not make a text toxic.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from granulith.llm import flat

#: Labelled rows the model is fitted on, at most: those with the smallest hash of the id.
FIT_ROWS = 20_000
#: Words a score may use, at most.
FEATURES = 512
#: A word enters if so many of the texts hold it; those with the clearest difference between the classes come first.
MIN_DOCS = 2
#: A word's weight is held back the more, the fewer standard errors under this its difference between the classes is.
EVIDENCE = 5.0
SWAP_WEIGHT = 10.0
RIDGE = 0.3
BITS = 24

# Terms that name groups of people; a swap stays inside one list.
IDENTITY = [
    ["women", "men", "girls", "boys"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "african", "european", "arab"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["disabled", "deaf", "blind", "autistic"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "hindus"],
    ["ausländer", "einwanderer", "flüchtlinge"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "hindous"],
    ["immigrés", "étrangers", "réfugiés"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["musulmanes", "cristianos", "judíos", "hindúes"],
    ["inmigrantes", "extranjeros", "refugiados"],
]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _slots(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    end = np.cumsum(lens)
    sums = flat.prefix(flat.BYTE_VALUE[np.frombuffer(b"".join(raw), np.uint8)])
    return (flat.stretch(sums, end - lens, end) >> np.uint64(64 - BITS)).astype(np.int64)


def _block_slots(block: flat.Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of the distinct words of each text."""
    words = flat.Words(block, flat.letters_table())
    key = words.text_of().astype(np.int64) << BITS | (words.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(key)
    return key >> BITS, key & ((1 << BITS) - 1)


def _features(batches):
    for block in flat.blocks(batches):
        text, slot = _block_slots(block)
        at = np.searchsorted(text, np.arange(len(block) + 1))
        yield pa.RecordBatch.from_arrays(
            [block.column("toxic"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(slot, pa.int32()))],
            names=["toxic", "slots"])


def fit_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(toxic, slots) of at most `rows` labelled texts that are not held out; of several labels of an id the largest."""
    own = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` pairs of numbers, so the side to send around is bounded
    joined = flat.in_small_batches(docs).select("doc_id", "text").join(F.broadcast(own), "doc_id").select("toxic", "text")
    return joined.mapInArrow(_features, "toxic int, slots array<int>")


class Model:
    """Weights of slots, sorted by slot, and the intercept."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, intercept: float):
        self.slots, self.weights, self.intercept = slots, weights, intercept

    def score(self, text: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.intercept)
        if len(self.slots):
            i = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
            known = self.slots[i] == slot
            z += np.bincount(text[known], self.weights[i[known]], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(toxic: np.ndarray, at: np.ndarray, slots: np.ndarray, swap_weight: float = SWAP_WEIGHT) -> Model:
    """Fit to texts i with the slots `slots[at[i]:at[i + 1]]`. Without texts, or with one class only, the rate is the score."""
    n = len(toxic)
    y = np.asarray(toxic, float)
    rate = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate / (1 - rate)))
    none = np.zeros(0, np.int64)
    if n == 0 or y.min() == y.max():
        return Model(none, none.astype(float), base)
    text = np.repeat(np.arange(n), np.diff(at))
    all_slots, where = np.unique(slots, return_inverse=True)
    total = np.bincount(where, minlength=len(all_slots))
    bad = np.bincount(where, y[text], minlength=len(all_slots))
    n1, n0 = y.sum(), n - y.sum()
    p = total / n
    z = np.abs(bad / n1 - (total - bad) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    terms = [_slots(ts) for ts in IDENTITY]
    identity = np.isin(all_slots, np.concatenate(terms))
    chosen = np.flatnonzero((total >= MIN_DOCS) | identity)
    chosen = chosen[np.lexsort((-z[chosen], ~identity[chosen]))][:FEATURES]
    used = np.sort(all_slots[chosen])
    # swaps of a term that the texts never name lead to a word without weight: one more column each
    extra = np.setdiff1d(np.concatenate(terms), used)
    columns = {s: k for k, s in enumerate(np.concatenate([used, extra]).tolist())}
    x = np.zeros((n, len(columns) + 1), np.float32)
    x[:, -1] = 1
    keep = np.isin(slots, used)
    x[text[keep], [columns[s] for s in slots[keep].tolist()]] = 1
    # penalty on the change of the score of each text that names a when it names b of the list instead; where it names
    # both, b is there already and only a goes
    swaps = np.zeros((x.shape[1], x.shape[1]))
    for ts in terms:
        cols = [columns[s] for s in ts.tolist()]
        both = x[:, cols].T.astype(float) @ x[:, cols]
        for k, a in enumerate(cols):
            for m, b in enumerate(cols):
                if a != b:
                    alone = both[k, k] - both[k, m]
                    swaps[a, a] += both[k, k]
                    swaps[b, b] += alone
                    swaps[a, b] -= alone
                    swaps[b, a] -= alone
    # the same texts with the term absent: a mention by itself must not move the score either
    for a in {columns[s] for ts in terms for s in ts.tolist()}:
        swaps[a, a] += float(x[:, a].sum())
    ridge = np.full(x.shape[1], RIDGE)
    ridge[:len(used)] *= np.maximum(1.0, EVIDENCE / np.maximum(z[np.searchsorted(all_slots, used)], 1e-3)) ** 2
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = base
    fixed = swap_weight * swaps / max(1, len(terms)) + np.diag(ridge)
    for _ in range(25):
        gradient, curve = fixed @ w, fixed.copy()
        for lo in range(0, n, 1024):  # a part of the rows at a time, as the sums need
            part = x[lo:lo + 1024]
            q = 1 / (1 + np.exp(-np.clip(part @ w.astype(np.float32), -30, 30).astype(float)))
            gradient += part.T @ (q - y[lo:lo + 1024]).astype(np.float32)
            curve += part.T @ (part * (q * (1 - q))[:, None].astype(np.float32))
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    order = np.argsort(list(columns))
    return Model(np.array(list(columns), np.int64)[order], w[:-1][order], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model from the bounded sample; what reaches the driver is at most `rows` lists of distinct words.

    Null ids, null labels and null texts are not learned from or count as texts without words; an id with several labels
    takes the largest, one with several rows counts each; ties in the order of the sample go to the smaller id. Without
    labelled rows, or with one class, every score is the rate of the labels."""
    got = fit_rows(docs, labels, rows).toArrow()
    lists = got.column("slots").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return train(got.column("toxic").to_numpy(), lists.offsets.to_numpy(), lists.flatten().to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted per row of docs, from the text alone.

    Null and empty texts have no words and get the intercept's score; a null doc_id counts as not held out; repeated
    rows and further columns change nothing; rows are independent, nothing is shuffled.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for block in flat.blocks(batches):
            s = model.score(*_block_slots(block), len(block))
            yield flat.records(["doc_id", "score", "predicted"],
                               [block.column("doc_id"), s, (s >= 0.5).astype(np.int32)])

    out = flat.in_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they were, whose text is not predicted to be toxic. Null and empty texts get the
    intercept's verdict, repeated rows and null ids are rows like others, an empty table stays empty."""
    def clean(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        return pa.array(np.concatenate([np.zeros(0, bool), *[
            model.score(*_block_slots(b), len(b)) < 0.5 for b in flat.blocks(iter([batch]))]]))

    # only the text goes to Python and only the answer comes back; the rows stay where they are
    return flat.in_small_batches(docs).where(F.arrow_udf(clean, "boolean")("text"))

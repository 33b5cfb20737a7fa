"""Benchmark passages in texts by Wu-Manber multi-pattern search over words.

Patterns of one length m are searched together. A table gives, for the block of two words that ends the window of m
words, how far the window can move on without missing a pattern; only where that is zero, the bucket of the patterns
with this last block is compared word by word, and the words' bytes once more.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from granulith.llm import flat

WINDOW = 10
#: Benchmark text searched in one pass over the documents; a larger benchmark takes further passes.
PASS_BYTES = 8 << 20
STRIDE = 256


def item_words(text: str | None) -> list[bytes]:
    table = bytes(b or 32 for b in flat.letters_table())
    return (text or "").encode().translate(table).split()


class Matcher:
    """Shift table and suffix buckets of the patterns (rows of word ids) of one length."""

    def __init__(self, patterns: np.ndarray):
        self.n, self.m = patterns.shape
        self.block = min(2, self.m)
        self.bits = max(12, int(8 * self.n * self.m).bit_length())
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.uint8)
        for j in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self.slot(self.code(patterns, j)), self.m - 1 - j)
        last = self.code(patterns, self.m - 1)
        self.order = np.argsort(last, kind="stable")
        self.last, self.patterns = last[self.order], patterns[self.order]

    def code(self, rows: np.ndarray, j) -> np.ndarray:
        a = rows[..., j].astype(np.uint64)
        return a if self.block == 1 else a | rows[..., j - 1].astype(np.uint64) << np.uint64(32)

    def slot(self, code: np.ndarray) -> np.ndarray:
        return (flat.mix(code) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence; stretches of the texts move on side by side."""
        first, stop = at[:-1] + self.m - 1, at[1:]
        n = np.maximum(0, -(-(stop - first) // STRIDE))
        text = np.repeat(np.arange(len(first)), n)
        pos = first[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(pos + STRIDE, stop[text])
        found = []
        while len(pos):
            s = self.shift[self.slot(self.code(ids, pos))]
            found.append(pos[s == 0])
            pos = pos + np.maximum(s, 1)
            on = pos < end
            pos, end = pos[on], end[on]
        pos = np.concatenate(found) if found else np.zeros(0, np.int64)
        code = self.code(ids, pos)
        lo, hi = np.searchsorted(self.last, code), np.searchsorted(self.last, code, "right")
        n = hi - lo
        pos = np.repeat(pos, n) - self.m + 1
        pattern = np.repeat(lo, n) + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
        same = np.ones(len(pos), bool)
        for j in range(self.m):
            same &= ids[pos + j] == self.patterns[pattern, j]
        return pos[same], self.order[pattern[same]]


class Search:
    """All patterns of one pass: items are (item_id, text); windows of WINDOW words, or the whole of a shorter item."""

    def __init__(self, items: list[tuple[object, str | None]]):
        windows: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = item_words(text)
            for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
                windows.setdefault(tuple(w[i:i + WINDOW]), set()).add(str(item))
        vocabulary = sorted({w for p in windows for w in p})
        hashes = self.hashes(vocabulary)
        order = np.argsort(hashes)
        self.hash, self.word = hashes[order], [vocabulary[i] for i in order]
        ident = {w: i + 1 for i, w in enumerate(self.word)}
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for p in sorted(windows):
            by_length.setdefault(len(p), []).append(p)
        self.parts = [(Matcher(np.array([[ident[w] for w in p] for p in ps], np.int64)), [sorted(windows[p]) for p in ps])
                      for _, ps in sorted(by_length.items())]

    @staticmethod
    def hashes(words: list[bytes]) -> np.ndarray:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(lens)
        return flat.stretch(flat.prefix(flat.BYTE_VALUE[np.frombuffer(b"".join(words), np.uint8)]), end - lens, end)

    def block(self, words: flat.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are inside an occurrence, and the items found per text."""
        hit, items = np.zeros(len(words), bool), {}
        if not len(self.hash) or not len(words):
            return hit, items
        h = words.hashes()
        i = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        ids = np.where(self.hash[i] == h, i + 1, 0)
        for matcher, owners in self.parts:
            pos, pattern = matcher.find(ids, words.at)
            cover = flat.covered(pos, matcher.m, len(words))
            wrong = [w for w in np.flatnonzero(cover).tolist()
                     if words.bytes[words.start[w]:words.end[w]].tobytes() != self.word[ids[w] - 1]]
            if wrong:  # equal hashes of different words
                at = np.array(wrong)
                ok = np.searchsorted(at, pos) == np.searchsorted(at, pos + matcher.m)
                pos, pattern = pos[ok], pattern[ok]
                cover = flat.covered(pos, matcher.m, len(words))
            hit |= cover
            text = np.searchsorted(words.at, pos, "right") - 1
            for t, p in set(zip(text.tolist(), pattern.tolist())):
                items.setdefault(t, set()).update(owners[p])
        return hit, items


def _passes(benchmark: DataFrame):
    """Lists of items of at most PASS_BYTES of text each."""
    part, size = [], 0
    for row in benchmark.select("item_id", "text").where("item_id is not null").toLocalIterator():
        n = len((row[1] or "").encode())
        if part and size + n > PASS_BYTES:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += n
    yield part


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, `hits` (spans of words inside an occurrence) and `items` (ids as sorted text).

    Words are lower-cased runs of digits, letters and characters outside ASCII. Null and empty texts, on either side,
    have no words; items without an id are not searched; equal items with different ids are all reported; repeated
    rows are rows like others. The benchmark is taken in passes of bounded size over the documents, each of which
    adds to the hits of the one before; nothing is shuffled.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text string, n_words bigint, hits array<struct<start:int,end:int>>, items array<string>"
    out = flat.in_small_batches(docs).select("doc_id", "text")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(items, again, keep_text):
        def run(batches):
            search = Search(items)
            for block in flat.blocks(batches):
                words = flat.Words(block, flat.letters_table())
                hit, found = search.block(words)
                if again:
                    for i, (hs, its) in enumerate(zip(block.column("hits").to_pylist(), block.column("items").to_pylist())):
                        for s in hs:
                            hit[words.at[i] + s["start"]:words.at[i] + s["end"]] = True
                        if its:
                            found.setdefault(i, set()).update(its)
                hits: list = [[] for _ in range(len(block))]
                for t in np.unique(np.searchsorted(words.at, np.flatnonzero(hit), "right") - 1).tolist():
                    lo, hi = words.at[t], words.at[t + 1]
                    e = np.flatnonzero(np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]])))
                    hits[t] = [{"start": s, "end": x} for s, x in e.reshape(-1, 2).tolist()]
                texts = block.column("text") if keep_text else pa.nulls(len(block), pa.string())
                yield flat.records(["doc_id", "text", "n_words", "hits", "items"], [
                    block.column("doc_id"), texts, words.counts().astype(np.int64), pa.array(hits, spans),
                    pa.array([sorted(found.get(i, ())) for i in range(len(block))], pa.list_(pa.string()))])
        return run

    parts = list(_passes(benchmark))
    for k, items in enumerate(parts):
        out = out.mapInArrow(scan(items, k > 0, k + 1 < len(parts)), schema)
    return out.drop("text")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they were, that hold no window of the benchmark."""
    def only(items):
        search = Search(items)

        def clean(text: pa.Array) -> pa.Array:
            out = [np.zeros(0, bool)]
            for block in flat.blocks(iter([pa.RecordBatch.from_arrays([text], names=["text"])])):
                words = flat.Words(block, flat.letters_table())
                out.append(np.bincount(words.text_of()[search.block(words)[0]], minlength=len(block)) == 0)
            return pa.array(np.concatenate(out))
        return F.arrow_udf(clean, "boolean")

    # only the text goes to Python and only the answer comes back; the rows stay where they are
    docs = flat.in_small_batches(docs)
    for items in _passes(benchmark):
        docs = docs.where(only(items)("text"))
    return docs

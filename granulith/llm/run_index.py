"""Substring deduplication with a run-length index.

Windows of 100 bytes are filed under the smallest hash of their 24-byte strings. Where different stretches share such
an anchor, their contents are indexed: sorted suffixes, the Burrows-Wheeler transform and its runs. The length of the
match with the suffix sorted before is kept for run heads only; inside a run the same byte stands before both suffixes,
so streaming through the text gives the other lengths, each one less than the one before it. Positions that match
another suffix over 100 bytes are marked unless they are the first to hold their string.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granulith.llm import flat, repeats

WIDTH = 100
ANCHOR = 24
#: Doubled prefix lengths that the suffix sort goes through; the last covers any content.
LEVELS = [8, 16, 32, 64, 128, 256]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in each window of the given width, the leftmost of equal ones."""
    best, arg, have = values, np.arange(len(values)), 1
    while have < width:  # windows of `have` places are joined to windows of twice that, or of the rest
        step = min(have, width - have)
        a, b = slice(0, len(best) - step), slice(step, None)
        right = best[b] < best[a]
        best, arg = np.where(right, best[b], best[a]), np.where(right, arg[b], arg[a])
        have += step
    return arg


def file_windows(values: np.ndarray, key: np.ndarray, key_width: int, width: int, at: np.ndarray, lead: int = 0, tail: int = 0):
    """Stretches of windows with one anchor: (text, start in the text, windows, anchor's key, hash of the stretch).

    key[i] is the key of the anchor at i; a window at s takes the smallest key in [s + lead, s + width - tail - key_width].
    """
    inside = flat.window_starts(at, width)
    starts = np.flatnonzero(inside)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    arg = _least(key, width - key_width - lead - tail + 1)[starts + lead]
    head = np.ones(len(starts), bool)
    head[1:] = (arg[1:] != arg[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(head)
    n = np.diff(np.append(first, len(starts)))
    begin, anchor = starts[first], arg[first]
    with np.errstate(over="ignore"):
        whole = flat.stretch(flat.prefix(values), begin, begin + n - 1 + width) + flat.mix((anchor - begin).astype(np.uint64))
    text = np.searchsorted(at, begin, "right") - 1
    return text, begin - at[text], n, key[anchor], whole


class Index:
    """Run-length index over contents laid end to end, `bounds[i]:bounds[i + 1]` being content i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, order: np.ndarray):
        """`order` ranks the positions: of equal suffixes the one with the smaller rank is sorted first."""
        n = len(data)
        end = np.repeat(bounds[1:], np.diff(bounds))
        padded = np.concatenate([data.astype(np.uint64) + flat.ONE, np.zeros(max(LEVELS), np.uint64)])
        at = np.arange(n)
        key = np.zeros(n, np.uint64)
        for j in range(LEVELS[0]):
            key = key * np.uint64(257) + np.where(at + j < end, padded[at + j], 0)
        self.ranks = [np.unique(key, return_inverse=True)[1].astype(np.int64)]
        for have in LEVELS[:-1]:
            self.ranks.append(self.pair(self.ranks[-1], have, end))
        self.end, self.level = end, dict(zip(LEVELS, self.ranks))
        self.suffixes = np.lexsort((order, self.ranks[-1]))
        before = np.where(at > np.repeat(bounds[:-1], np.diff(bounds)), np.concatenate([[0], data[:-1]]).astype(np.int64), -1 - at)
        bwt = before[self.suffixes]
        self.heads = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        # samples at run heads: the position and its match with the suffix before
        self.sampled = self.suffixes[self.heads]
        self.lengths = self.common(self.suffixes[np.maximum(self.heads - 1, 0)], self.sampled)
        if len(self.lengths):
            self.lengths[0] = 0

    @staticmethod
    def pair(rank: np.ndarray, step: int, end: np.ndarray) -> np.ndarray:
        at = np.arange(len(rank)) + step
        second = np.where(at < end, rank[np.minimum(at, len(rank) - 1)] + 1, 0)
        return np.unique(rank * (len(rank) + 1) + second, return_inverse=True)[1].astype(np.int64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and b."""
        out = np.zeros(len(a), np.int64)
        for level in reversed(LEVELS):
            rank = self.level[level]
            while True:
                x, y = a + out, b + out
                ok = (x + level <= self.end[a]) & (y + level <= self.end[b])
                same = ok & (rank[np.where(ok, x, 0)] == rank[np.where(ok, y, 0)])
                out += level * same
                if not same.any() or level == LEVELS[-1]:
                    break
        return out

    def matching(self) -> np.ndarray:
        """Matching statistics: for every position the longest match with another suffix, to within LEVELS[0] bytes
        below it, streamed from the samples."""
        n = len(self.suffixes)
        reach = np.zeros(n, np.int64)
        reach[self.sampled] = self.lengths + self.sampled
        up = np.maximum.accumulate(reach) - np.arange(n)
        up = np.maximum(up, 0)
        down = np.zeros(n, np.int64)
        down[self.suffixes[:-1]] = up[self.suffixes[1:]]
        return np.maximum(up, down)

    def strings(self, width: int) -> np.ndarray:
        """A number for the string of `width` bytes at each position, equal for equal strings."""
        half = max(x for x in LEVELS if x <= width)
        return self.pair(self.level[half], width - half, self.end)


def stretches(block: flat.Block):
    data = flat.BYTE_VALUE[block.data]
    if len(data) < WIDTH:
        return file_windows(data, data, ANCHOR, WIDTH, block.bounds)
    return file_windows(data, flat.window_hashes(data, ANCHOR), ANCHOR, WIDTH, block.bounds)


def contents(block: flat.Block, text, start, n) -> list[bytes]:
    raw, begin = block.data.tobytes(), block.bounds[text] + start
    return [raw[b:e] for b, e in zip(begin.tolist(), (begin + n - 1 + WIDTH).tolist())]


#: Byte values of the second of two hashes of a window.
OTHER_VALUE = flat.mix(flat.BYTE_VALUE ^ np.uint64(0x5851F42D4C957F2D))


def window_keys(block: flat.Block, text, start):
    """Two hashes of the window at each start."""
    p = block.bounds[text] + start
    return tuple(flat.stretch(flat.prefix(t[block.data]), p, p + WIDTH) for t in (flat.BYTE_VALUE, OTHER_VALUE))


def compare(h, doc, start, n, content: list[bytes], within: bool):
    """(content, offset, length) of the spans of windows that another content holds earlier."""
    lens = np.fromiter(map(len, content), np.int64, len(content))
    bounds = np.concatenate([[0], np.cumsum(lens)])
    data = np.frombuffer(b"".join(content), np.uint8)
    which = np.repeat(np.arange(len(content)), lens)
    offset = np.arange(len(data)) - bounds[which]
    owner = np.lexsort((start[which] + offset, doc[which]))
    rank = np.empty(len(owner), np.int64)
    rank[owner] = np.arange(len(owner))
    index = Index(data, bounds, rank)
    # a match may be up to one level shorter in `matching` than it is; the strings decide
    marked = np.flatnonzero((index.matching() > WIDTH - LEVELS[0]) & (offset < n[which]))
    string = index.strings(WIDTH)[marked]
    order = np.lexsort((rank[marked], string))
    p, s = marked[order], string[order]
    group = repeats._groups(s) if len(s) else np.zeros(0, np.int64)
    first = p[np.searchsorted(group, np.arange(group[-1] + 1))][group] if len(s) else p
    d, f = which[p], which[first]
    later = (doc[d] > doc[f]) | ((start[d] + offset[p] > start[f] + offset[first]) if within else False)
    p = np.sort(p[later])
    if not len(p):
        return p, p, p
    new = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (which[p[1:]] != which[p[:-1]])])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(p)))
    return which[p[head]], offset[p[head]], count - 1 + WIDTH


def finish(block: flat.Block, text, start, length) -> pa.RecordBatch:
    begin = block.bounds[text] + start
    gone = repeats.cover(len(block.data), begin, begin + length)
    kept, at = block.data[~gone].tobytes(), np.concatenate([[0], np.cumsum(~gone)])[block.bounds]
    left = [kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    n = np.diff(block.bounds)
    return flat.records(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], [
        block.column("doc_id"), n, n - np.diff(at), repeats.runs(gone, block.bounds),
        [hashlib.sha256(x).hexdigest() for x in left], pa.array(left, pa.binary())])


def dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and `kept`, the remaining bytes.

    A byte goes if a 100-byte string over it also starts earlier: in a text of a smaller doc_id, or earlier in the same
    text. The first occurrence stays whole. Null texts are empty ones; texts under 100 bytes, and rows without an id,
    stay whole and remove nothing; repeated rows with one id are one place, so none removes the other.
    """
    return repeats.rewrite(docs, Method, True, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


class Method:
    WIDTH = WIDTH
    stretches, contents, window_keys, compare, finish = map(staticmethod, (stretches, contents, window_keys, compare, finish))

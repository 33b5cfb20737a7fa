"""Substring deduplication over words by recompression.

In each round runs of one token get a name, then pairs whose first token falls into the left and whose second token into
the right class of that round. A name is a hash of what it stands for, so all tasks give one string one name without
speaking to each other. Inside equal windows the tokens become equal names except near the borders: a round touches at
most the first and last token of the part that is still certain, and a name stands for at most 8 words, so in a window
of 50 words the names that reach into the 26 middle ones are the same wherever the window stands. The smallest of them,
with the words around it, files the window; windows that share a file are then compared.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granulith.llm import flat, repeats
from granulith.llm.run_index import OTHER_VALUE, _least

WIDTH = 50
#: Longest run, in words, that is named in a round; a pair then doubles that.
ROUNDS = [2, 4]
#: Words at each end of a window whose names may depend on what is outside: a run and a pair in each round.
MARGIN = sum(cap + cap for cap in ROUNDS)
#: Words before and from an anchor that lie in every window it files: a name reaches back by less than twice the last cap.
BEFORE, FROM = MARGIN - 2 * ROUNDS[-1] + 1, MARGIN + 1


def rename(tokens: np.ndarray, length: np.ndarray, first: np.ndarray, cap: int, number: int):
    """One round: names, the words each stands for, and whether it begins a text."""
    with np.errstate(over="ignore"):
        # runs of equal tokens, of at most `cap` words in all
        head = np.ones(len(tokens), bool)
        head[1:] = (tokens[1:] != tokens[:-1]) | first[1:]
        run = np.cumsum(head) - 1
        at = np.flatnonzero(head)
        count = np.diff(np.append(at, len(tokens)))
        named = (count > 1) & (count * length[at] <= cap)
        keep = head | ~named[run]
        size = np.where(named, count, 1)[run][keep]
        tokens, length, first = tokens[keep], length[keep] * size, first[keep]
        tokens = np.where(size > 1, flat.mix(tokens + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number)), tokens)
        # pairs: left class, then right class
        right = (flat.mix(tokens + flat.mix(np.uint64(1000 + number))) >> np.uint64(63)).astype(bool)
        pair = np.zeros(len(tokens), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~first[1:]
        other = np.zeros(len(tokens), bool)
        other[1:] = pair[:-1]
        both = np.append(tokens[1:], np.uint64(0))
        name = flat.mix(tokens * np.uint64(0xD6E8FEB86659FD93) + flat.mix(both + np.uint64(number)))
        tokens = np.where(pair, name, tokens)[~other]
        length = np.where(pair, length + np.append(length[1:], 0), length)[~other]
        return tokens, length, first[~other]


def stretches(block: flat.Block):
    words = flat.Words(block, flat.plain_table())
    at, value = words.at, words.hashes()
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    starts = np.flatnonzero(flat.window_starts(at, WIDTH))
    if not len(starts):
        return empty
    first = np.zeros(len(value), bool)
    first[at[:-1][at[1:] > at[:-1]]] = True
    tokens, length = value, np.ones(len(value), np.int64)
    for number, cap in enumerate(ROUNDS):
        tokens, length, first = rename(tokens, length, first, cap, number)
    name = np.repeat(flat.mix(tokens), length)
    begin = np.repeat(np.cumsum(length) - length, length)
    where = _least(name, WIDTH - 2 * MARGIN)[starts + MARGIN]
    anchor = begin[where]
    # short names are common: the words around that the windows share make the key of a file as rare as a repeat
    around = flat.window_hashes(value, BEFORE + FROM)
    key = flat.mix(name[where] + around[anchor - BEFORE])
    head = np.ones(len(starts), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    one = np.flatnonzero(head)
    n = np.diff(np.append(one, len(starts)))
    start, anchor = starts[one], anchor[one]
    with np.errstate(over="ignore"):
        whole = flat.stretch(flat.prefix(value), start, start + n - 1 + WIDTH) + flat.mix((anchor - start).astype(np.uint64))
    text = np.searchsorted(at, start, "right") - 1
    return text, start - at[text], n, key[one], whole


def contents(block: flat.Block, text, start, n) -> list[bytes]:
    """The words of each stretch, joined by a space."""
    words = flat.Words(block, flat.plain_table())
    raw, first = block.data.tobytes(), words.at[text] + start
    lo, hi = words.start, words.end
    spaced = np.where(words.inside, block.data, 32).tobytes()
    single = bool(len(lo) < 2 or ((lo[1:] - hi[:-1] == 1) | np.isin(np.arange(1, len(lo)), words.at)).all())
    out = []
    for f, k in zip(first.tolist(), (n - 1 + WIDTH).tolist()):
        piece = spaced[lo[f]:hi[f + k - 1]]
        out.append(piece if single else b" ".join(raw[a:b] for a, b in zip(lo[f:f + k].tolist(), hi[f:f + k].tolist())))
    return out


def window_keys(block: flat.Block, text, start):
    """Two hashes of the words of the window at each start."""
    words = flat.Words(block, flat.plain_table())
    p, out = words.at[text] + start, []
    for table in (flat.BYTE_VALUE, OTHER_VALUE):
        value = flat.stretch(flat.prefix(table[block.data]), words.start, words.end)
        out.append(flat.stretch(flat.prefix(value), p, p + WIDTH))
    return out


def compare(h, doc, start, n, content: list[bytes], within: bool):
    """(content, offset, length) of the spans of windows that start in a text of a smaller doc_id too."""
    lens = n.astype(np.int64) - 1 + WIDTH
    bounds = np.concatenate([[0], np.cumsum(lens)])
    data = np.frombuffer(b" ".join(content), np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    begins = np.append(0, ends[:-1] + 1)
    value = flat.stretch(flat.prefix(flat.BYTE_VALUE[data]), begins, ends)
    which = np.repeat(np.arange(len(content)), n)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    p = bounds[which] + offset
    window = flat.mix(flat.stretch(flat.prefix(value), p, p + WIDTH) + flat.mix(h[which].astype(np.uint64)))
    order = np.lexsort((doc[which], window))
    group = repeats._groups(window[order])
    head = np.searchsorted(group, np.arange(group[-1] + 1)) if len(group) else group
    least = order[head][group]
    later = doc[which[order]] > doc[which[least]]
    order, least = order[later], least[later]
    # names and hashes only point at the repeat; the words decide
    same = np.ones(len(order), bool)
    a, b = begins[p[order]], begins[p[least]]
    la, lb = ends[p[order] + WIDTH - 1] - a, ends[p[least] + WIDTH - 1] - b
    same &= la == lb
    for k in range(int(la.max()) if len(la) else 0):
        on = k < la
        same &= ~on | (data[np.where(on, a + k, 0)] == data[np.where(on & (k < lb), b + k, 0)])
    at = np.sort(order[same])
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (which[at[1:]] != which[at[:-1]])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return which[at[first]], offset[at[first]], count - 1 + WIDTH


def finish(block: flat.Block, text, start, length) -> pa.RecordBatch:
    words = flat.Words(block, flat.plain_table())
    begin = words.at[text] + start
    gone = repeats.cover(len(words), begin, begin + length)
    raw, at = block.data.tobytes(), words.at
    lo, hi = words.start.tolist(), words.end.tolist()
    left, keep = [], ~gone
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = np.flatnonzero(keep[a:b]) + a
        left.append(b" ".join([raw[lo[i]:hi[i]] for i in own.tolist()]))
    return flat.records(["doc_id", "n_words", "n_removed", "kept_sha256", "kept"], [
        block.column("doc_id"), words.counts().astype(np.int64), flat.sums(gone, at),
        [hashlib.sha256(x).hexdigest() for x in left], pa.array(left, pa.binary()).cast(pa.string())])


def dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 and `kept`, the kept words joined by a space.

    A word goes if a window of 50 words over it also starts in a text of a smaller doc_id. Words are taken unchanged.
    Null and empty texts have none; texts of fewer than 50 words, and rows without an id, stay whole and remove
    nothing; rows with one doc_id don't remove from each other.
    """
    return repeats.rewrite(docs, Method, False, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


class Method:
    WIDTH = WIDTH
    stretches, contents, window_keys, compare, finish = map(staticmethod, (stretches, contents, window_keys, compare, finish))

"""Hierarchical packing of tokenised documents into context windows of several lengths.

A document is cut into whole longest windows and a remainder. The remainder is routed to the shortest tier that holds it;
windows of a tier are opened by its longest remainders, their gaps filled from shorter tiers, and what still gapes is
closed by cutting one further remainder. Windows are dealt over step groups of about equal numbers of tokens.

Tokens never leave the task that made them, so nothing as large as the corpus is shuffled. Less than one longest window of
remainders is left over in each task; those meet in groups of FAN tasks, theirs again in groups of FAN, until one group
closes the last ones with windows of shrinking powers of two. No window is padded.
"""

import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from granulith.llm import flat
from granulith.llm.prefix_viterbi import ragged
from granulith.session import write_and_read

#: Lengths of windows, each a power of two.
TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 1 << 16
#: Bytes of texts that are packed together in a task.
BLOCK_BYTES = 4 << 20
#: Tasks or groups whose leftovers meet in one group.
FAN = 16
#: Distinct units and ids a task keeps from block to block before it starts anew.
KEPT_UNITS, KEPT_IDS = 1 << 20, 1 << 23
EMITTED = 1024


class Words:
    """Ids of texts by a tokenizer whose tokens never cross ASCII white space.

    A word is a unit of its own; one of plain ASCII, without an apostrophe or "<", is cut further where letters meet other
    characters and its letters are lowered, as the tokenizer does itself. Each distinct unit is tokenised once a task.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"           # the task has one core
        self.tokenizer = Tokenizer.from_str(model)
        self.merges = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.kept, self.at = array("I"), array("q", [0])

    def _learn(self, units: list[bytes]) -> None:
        plain = [u for u in units if u.isalpha() and u.islower()]
        for u in plain:
            self._keep(u, [t.id for t in self.merges.tokenize(u.decode())])
        rest = [u for u in units if not (u.isalpha() and u.islower())]
        for lo in range(0, len(rest), 4096):
            some = rest[lo: lo + 4096]
            for u, e in zip(some, self.tokenizer.encode_batch_fast([u.decode() for u in some], add_special_tokens=False)):
                self._keep(u, e.ids)

    def _keep(self, unit: bytes, ids: list[int]) -> None:
        self.code[unit] = len(self.code)
        self.kept.extend(ids)
        self.at.append(len(self.kept))

    def ids(self, block: flat.Block, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block end to end, each text's followed by `end`, and how many each text has."""
        w = flat.Words(block, flat.plain_table())
        size = w.end - w.start
        odd = np.concatenate([[0], np.cumsum((block.data >= 128) | (block.data == 39) | (block.data == 60))])
        plain = np.repeat(odd[w.end] == odd[w.start], size)
        chars = block.data[w.inside]
        upper = (chars >= 65) & (chars <= 90)
        letter = upper | (chars >= 97) & (chars <= 122)
        chars[upper & plain] += 32
        begin = np.concatenate([[0], np.cumsum(size)])
        cut = np.zeros(len(chars), bool)
        cut[1:] = plain[1:] & (letter[1:] != letter[:-1])
        cut[begin[:-1]] = True
        start = np.flatnonzero(cut)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [
            None, pa.py_buffer(np.append(start, len(chars)).astype(np.int64)), pa.py_buffer(chars)]).dictionary_encode()
        if len(self.code) > KEPT_UNITS or len(self.kept) > KEPT_IDS:
            self.forget()
        distinct = units.dictionary.to_pylist()
        self._learn([u for u in distinct if u not in self.code])
        code = np.fromiter(map(self.code.__getitem__, distinct), np.int64, len(distinct))
        at = np.array(self.at)
        ids, n = ragged(np.array(self.kept), at[:-1], np.diff(at), code[units.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, begin[w.at])][1:]
        counts = np.diff(np.concatenate([[0], ends])) + 1
        return np.insert(ids, ends, end).astype("<u4"), counts


class Pool:
    """Remainders (document, start, length) by length: takes the longest that fits, or the shortest that doesn't."""

    def __init__(self):
        self.by: dict[int, list] = {}
        self.mask = 0

    def add(self, doc: int, start: int, length: int) -> None:
        if length not in self.by:
            self.by[length] = []
            self.mask |= 1 << length
        self.by[length].append((doc, start, length))

    def _take(self, length: int):
        item = self.by[length].pop()
        if not self.by[length]:
            del self.by[length]
            self.mask ^= 1 << length
        return item

    def longest(self, most: int):
        fits = self.mask & ((2 << most) - 1)
        return self._take(fits.bit_length() - 1) if fits else None

    def head(self, length: int):
        """A head of just this length, cut off the shortest longer remainder, whose rest stays."""
        longer = self.mask >> (length + 1)
        if not longer:
            return None
        doc, start, n = self._take(length + (longer & -longer).bit_length())
        self.add(doc, start + length, n - length)
        return doc, start, length


def fill(counts, tiers=TIERS) -> tuple[list[tuple[int, list]], list]:
    """Windows (tier, pieces) that pieces (document, start, length) fill to the last token, and the pieces left over, in
    all fewer tokens than the longest window."""
    longest, pool, windows = tiers[0], Pool(), []
    for doc, n in enumerate(counts):
        whole = n // longest
        windows += [(longest, [(doc, k * longest, longest)]) for k in range(whole)]
        if n % longest:
            pool.add(doc, whole * longest, n % longest)
    for tier, shorter in zip(tiers, (*tiers[1:], 0)):
        while pool.mask >> (shorter + 1):
            window, gap = [], tier
            while gap and (item := pool.longest(gap) or pool.head(gap)):
                window.append(item)
                gap -= item[2]
            if gap:
                return windows, window                            # the pool is empty
            windows.append((tier, window))
    return windows, []


def close(pieces: list) -> list[tuple[int, list]]:
    """Windows of shrinking powers of two that hold the last pieces, cut where a window ends."""
    left, windows = sum(p[2] for p in pieces), []
    pieces = pieces[::-1]
    while left:
        tier = 1 << (left.bit_length() - 1)
        window, gap = [], tier
        while gap:
            doc, start, n = pieces.pop()
            if n > gap:
                pieces.append((doc, start + gap, n - gap))
            window.append((doc, start, min(n, gap)))
            gap -= min(n, gap)
        windows.append((tier, window))
        left -= tier
    return windows


def steps(windows: list[tuple[int, list]], step_tokens: int) -> list[int]:
    """Step group of each window: every tier is dealt out in turn, going on where the tier before it ended."""
    n = max(1, round(sum(t for t, _ in windows) / step_tokens))
    out, order = [0] * len(windows), sorted(range(len(windows)), key=lambda i: -windows[i][0])
    for place, i in enumerate(order):
        out[i] = place % n
    return out


class Writer:
    """Pieces of documents as rows. A document here is a stretch of tokens that starts at `begin` of its own document."""

    def __init__(self, names: list[str], level: int, group: int, step_tokens: int):
        self.names, self.group, self.step_tokens = names, group, step_tokens
        self.sequence, self.step = (level << 56) | (group << 24), (level << 56) | (group << 24)

    def rows(self, windows, doc_ids: pa.Array, begin, tokens, ids: np.ndarray, at):
        """Record batches of the windows' pieces; at: where each document's ids start."""
        step = steps(windows, self.step_tokens)
        flat_rows = [(d, s, n, k, tier) for k, (tier, window) in enumerate(windows) for d, s, n in window]
        for lo in range(0, len(flat_rows), EMITTED):
            doc, start, length, k, tier = (np.array(c, np.int64) for c in zip(*flat_rows[lo: lo + EMITTED]))
            offset = self._offsets(flat_rows, lo, len(doc))
            yield self._batch(doc, start, length, ids, at, doc_ids, begin, tokens, pa.array(self.sequence + k), pa.array(offset),
                              pa.array(tier.astype(np.int32)), pa.array(self.step + np.array(step, np.int64)[k]))
        self.sequence += len(windows)
        self.step += max(step, default=-1) + 1

    def loose(self, pieces, doc_ids, begin, tokens, ids, at):
        for lo in range(0, len(pieces), EMITTED):
            doc, start, length = (np.array(c, np.int64) for c in zip(*pieces[lo: lo + EMITTED]))
            none = pa.nulls(len(doc), pa.int64())
            yield self._batch(doc, start, length, ids, at, doc_ids, begin, tokens, none, none, pa.nulls(len(doc), pa.int32()), none)

    @staticmethod
    def _offsets(rows, lo, n):
        hi = lo
        while lo and rows[lo - 1][3] == rows[lo][3]:              # a window may start in the batch before
            lo -= 1
        out, k, place = [], None, 0
        for j in range(lo, hi + n):
            place = place if rows[j][3] == k else 0
            k = rows[j][3]
            if j >= hi:
                out.append(place)
            place += rows[j][2]
        return np.array(out, np.int64)

    def _batch(self, doc, start, length, ids, at, doc_ids, begin, tokens, sequence, offset, tier, step):
        own, _ = ragged(ids, at[doc] + start, length, np.arange(len(doc)))
        ends = np.concatenate([[0], np.cumsum(length)]) * 4
        data = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int32)),
                                                                   pa.py_buffer(np.ascontiguousarray(own, "<u4"))])
        return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), pa.array(begin[doc] + start), pa.array(length), data, pa.array(tokens[doc]),
                                           sequence, offset, tier, step, pa.array(np.full(len(doc), self.group))], names=self.names)


def _from_rows(table) -> tuple:
    """Columns of loose rows as documents: ids, begin, document tokens, all ids end to end, and where each starts."""
    doc_ids = table.column("doc_id")
    doc_ids = doc_ids.combine_chunks() if isinstance(doc_ids, pa.ChunkedArray) else doc_ids
    length = table.column("length").to_numpy().astype(np.int64)
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<u4")
    return doc_ids, table.column("start").to_numpy(), table.column("doc_tokens").to_numpy(), ids, np.cumsum(length) - length, length


def pack(docs: DataFrame, model_path: str, end: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of all whole documents (doc_id, text), one row each.

    doc_id; start, length and doc_tokens long, in tokens of the document with its end token; ids binary, the piece's ids
    as little-endian 32-bit numbers; sequence_id, offset long: the window and the place in it; tier int, the window's
    length; step_id long, its step group. Every window is filled exactly; every token is in one piece.

    The tokenizer file's tokens must not cross ASCII white space, as where white space is dropped before the merges. A null
    or empty text is its end token alone; repeated rows and null ids are rows like others; other columns are left out, so
    their names can't clash; an empty table gives no rows. A single text is held in memory whole. Window numbers depend on
    how the table is split into tasks.
    """
    with open(model_path, encoding="utf-8") as f:
        model = f.read()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_id", "grp"]
    schema = (f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids binary, doc_tokens long, sequence_id long, "
              "offset long, tier int, step_id long, grp long")

    def local(batches):
        words, writer, kept = Words(model), Writer(names, 0, TaskContext.get().partitionId(), step_tokens), None
        for block in flat.blocks(batches, most=BLOCK_BYTES):
            ids, counts = words.ids(block, end)
            doc_ids, begin, tokens = block.column("doc_id"), np.zeros(len(block), np.int64), counts
            if kept:                                              # the leftovers of the block before stand first
                doc_ids, begin, tokens = pa.concat_arrays([kept[0], doc_ids]), np.append(kept[1], begin), np.append(kept[2], tokens)
                ids, counts = np.append(kept[3], ids), np.append(kept[4], counts)
            at = np.cumsum(counts) - counts
            windows, rest = fill(counts.tolist(), tiers)
            yield from writer.rows(windows, doc_ids, begin, tokens, ids, at)
            doc, start, length = np.array(rest, np.int64).reshape(-1, 3).T
            kept = (doc_ids.take(pa.array(doc)), begin[doc] + start, tokens[doc], ragged(ids, at[doc] + start, length, np.arange(len(doc)))[0], length)
        if kept:
            at = np.cumsum(kept[4]) - kept[4]
            yield from writer.loose([(i, 0, int(n)) for i, n in enumerate(kept[4])], kept[0], kept[1], kept[2], kept[3], at)

    def meet(level: int, last: bool):
        def one(key, table):
            writer = Writer(names, level, key[0].as_py(), step_tokens)
            table = table.sort_by([("grp", "ascending"), ("doc_tokens", "ascending"), ("start", "ascending")])
            doc_ids, begin, tokens, ids, at, length = _from_rows(table)
            windows, rest = fill(length.tolist(), tiers)
            if last:
                windows, rest = windows + close(rest), []
            batches = [*writer.rows(windows, doc_ids, begin, tokens, ids, at), *writer.loose(rest, doc_ids, begin, tokens, ids, at)]
            return pa.Table.from_batches(batches)
        return one

    made = write_and_read(flat.in_small_batches(docs.select("doc_id", "text")).mapInArrow(local, schema), "packed")
    done, level = made.where("sequence_id is not null"), 0
    loose = made.where("sequence_id is null")
    highest = loose.agg(F.max("grp")).first()[0]
    while highest is not None:
        level, highest = level + 1, highest // FAN
        joined = loose.withColumn("up", F.floor(F.col("grp") / FAN))
        made = write_and_read(joined.groupBy("up").applyInArrow(meet(level, highest == 0), schema), "packed")
        done = done.unionByName(made.where("sequence_id is not null"))
        loose = made.where("sequence_id is null")
        if highest == 0:
            break
    return done.drop("grp")

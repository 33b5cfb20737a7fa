"""Texts of an Arrow batch as one flat byte array: words, hashes and windows as array arithmetic.

The helpers run inside tasks. They take whole texts, in blocks of whole rows, so that memory follows the block
size and, for one very long text, its length.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Bytes that separate words: space and the five controls from tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
ONE = np.uint64(1)
BATCH_ROWS = 1024


def in_small_batches(df):
    """df, its session set to hand rows to Python in small batches: texts are long, and several copies of a batch live
    on both sides of the border."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def plain_table() -> np.ndarray:
    """Translation that keeps every byte and sends white space to 0 (a NUL stays a word byte as 1)."""
    t = np.arange(256, dtype=np.uint8)
    t[0] = 1
    t[list(SPACES)] = 0
    return t


def lower_table() -> np.ndarray:
    """As `plain_table`, with A-Z lowered."""
    t = plain_table()
    t[65:91] += 32
    return t


def letters_table() -> np.ndarray:
    """Words of digits, letters and everything outside ASCII; A-Z lowered, all else separates."""
    t = np.zeros(256, np.uint8)
    t[48:58] = np.arange(48, 58)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


class Block:
    """Rows `lo` to `hi` of a batch, their texts end to end in `data`, text i at `bounds[i]:bounds[i + 1]`."""

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, bounds: np.ndarray):
        self.batch, self.lo, self.hi, self.data, self.bounds = batch, lo, hi, data, bounds

    def __len__(self) -> int:
        return self.hi - self.lo

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.names.index(name)).slice(self.lo, self.hi - self.lo)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole rows of at most `most` bytes, or of one longer row; a null text is an empty one."""
    for batch in batches:
        col = pc.fill_null(batch.column(batch.schema.names.index(column)), "")
        col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
        _, off, data = col.buffers()
        off = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
            yield Block(batch, lo, hi, data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo])
            lo = hi


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1, kept for the next block."""
    if not _powers or len(_powers[0]) < n:
        made = []
        with np.errstate(over="ignore"):
            for b in (BASE, INVERSE):
                p = np.full(max(n, BLOCK_BYTES + 64), b, np.uint64)
                p[0] = ONE
                made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums that give the polynomial hash of any stretch, see `stretch`."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
        return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end], the same wherever the stretch stands."""
    with np.errstate(over="ignore"):
        raw = (sums[end] - sums[start]) * powers(len(sums))[1][start]
        return mix(raw + (np.asarray(end, np.uint64) - np.asarray(start, np.uint64)) * np.uint64(0xA0761D6478BD642F))


class Words:
    """Words of a block: byte positions `start`, `end`, and `at[i]:at[i + 1]`, the words of text i."""

    def __init__(self, block: Block, table: np.ndarray):
        self.bytes = table[block.data]
        inside = self.bytes != 0
        n = len(inside)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        filled = block.bounds[1:] > block.bounds[:-1]
        begin, stop = block.bounds[:-1][filled], block.bounds[1:][filled] - 1
        if n:
            first[begin] = inside[begin]
            last[stop] = inside[stop]
        self.inside = inside
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, block.bounds)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def hashes(self) -> np.ndarray:
        return stretch(prefix(BYTE_VALUE[self.bytes]), self.start, self.end)

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts())


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of values[i:i + n] for every i (windows over the ends of texts included: see `window_starts`)."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    i = np.arange(len(values) - n + 1)
    return stretch(prefix(values), i, i + n)


def window_starts(at: np.ndarray, n: int) -> np.ndarray:
    """True at starts of windows of n that stay inside one text."""
    total = int(at[-1]) if len(at) else 0
    if total < n:
        return np.zeros(0, bool)
    ok = np.ones(total - n + 1, bool)
    ends = at[1:-1]
    ends = ends[(ends > 0) & (ends < total)]
    for back in range(1, n):
        p = ends - back
        ok[p[(p >= 0) & (p < len(ok))]] = False
    return ok


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values per text."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return np.diff(out[bounds])


def covered(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """True where one of the windows [start, start + width) lies."""
    d = np.zeros(total + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, total), -1)
    return np.cumsum(d[:total]) > 0


def records(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

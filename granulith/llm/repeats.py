"""Long repeats across a corpus, exactly: what two substring operators share.

Both remove what is covered by windows of WIDTH units (bytes or words) that also start earlier. A window is filed under
an anchor that its own content picks, so equal windows meet under equal anchors. Neighbouring windows with one anchor
travel as one row (a stretch) of a few numbers. Then:

1. equal stretches are reduced to the first, in each task before the shuffle and after it; the others are removed whole;
2. an anchor that is left with different stretches may still hold equal windows at their borders: only these stretches'
   contents are fetched and compared, window by window; where they are too many for one task, each window goes to the
   first under two hashes of its own;
3. the removed spans of a text are gathered and the text is rewritten.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from granulith.llm import flat
from granulith.session import write_and_read

ROW_BITS = (1 << 23) - 1
#: Rows of one anchor held together; beyond, the anchor counts as having different stretches, which only costs work.
HELD_ROWS = 1 << 20
GONE, STRETCH = 0, 1
COMPARE_BYTES = 1 << 20
#: Units of one anchor's different stretches that are compared in one task; beyond, its windows are compared one by one.
FULL_UNITS = 1 << 20


def _place(row, start, n):
    return row.astype(np.int64) << 40 | start.astype(np.int64) << 8 | n.astype(np.int64)


def _split(place):
    return place >> 40, place >> 8 & 0xFFFFFFFF, place & 0xFF


def _groups(*keys) -> np.ndarray:
    """Group number of each row, rows with equal keys being neighbours."""
    change = np.zeros(len(keys[0]), bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.cumsum(change)


def reduce_stretches(h, s, doc, place, within: bool, hot: bool = False):
    """Of rows of whole anchors: which are removed whole, and which must be compared (several stretches left).

    `within`: an earlier start in the same text counts as earlier too; otherwise only a smaller doc_id does.
    """
    _, start, _ = _split(place)
    order = np.lexsort((start, doc, s, h))
    h, s, doc, place, start = h[order], s[order], doc[order], place[order], start[order]
    if not len(h):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    same = _groups(h, s)
    first = np.searchsorted(same, np.arange(same[-1] + 1))[same]
    gone = (doc > doc[first]) | ((start > start[first]) if within else False)
    anchor = _groups(h)
    several = np.bincount(anchor, (np.arange(len(h)) == first).astype(float))[anchor] > 1
    return order, gone, ~gone & (several | hot)


def _rows(kind, h, doc, place, s=None):
    return flat.records(["kind", "h", "s", "doc_id", "place"], [
        np.full(len(h), kind, np.int8), h.view(np.int64), (s if s is not None else np.zeros(len(h))).astype(np.int64), doc, place])


SCHEMA = "kind byte, h long, s long, doc_id long, place long"


def removed(docs: DataFrame, method, within: bool) -> DataFrame:
    """(doc_id, row, start, length): removed spans of the texts, in units, overlapping ones included."""
    rows = keyed(docs).where("doc_id is not null and text is not null")

    def file(batches):
        for block in flat.blocks(batches):
            text, start, n, h, s = method.stretches(block)
            doc = block.column("doc_id").to_numpy()[text]
            row = block.column("row").to_numpy()[text]
            h, s, place = h.view(np.int64), s.view(np.int64), _place(row, start, n)
            order, gone, _ = reduce_stretches(h, s, doc, place, within)
            h, s, doc, place = h[order], s[order], doc[order], place[order]
            # these are decided and only pass through, so they are dealt out by their own place, not by what they share
            yield _rows(GONE, flat.mix(place[gone].view(np.uint64) ^ flat.mix(doc[gone].view(np.uint64))), doc[gone], place[gone])
            keep = ~gone
            yield _rows(STRETCH, h[keep], doc[keep], place[keep], s[keep])

    def reduce(batches):
        held, size, hot = [], 0, None

        def work(h, s, doc, place, hot):
            order, gone, compare = reduce_stretches(h, s, doc, place, within, hot)
            h, doc, place = h[order], doc[order], place[order]
            yield _rows(GONE, h[gone], doc[gone], place[gone])
            yield _rows(STRETCH, h[compare], doc[compare], place[compare])

        for batch in batches:
            kind, h, s, doc, place = (c.to_numpy() for c in batch.columns)
            out = kind == GONE
            if out.any():
                yield _rows(GONE, h[out], doc[out], place[out])
            held.append(tuple(x[~out] for x in (h, s, doc, place)))
            size += len(held[-1][0])
            if size < HELD_ROWS // 4:
                continue
            h, s, doc, place = (np.concatenate(x) for x in zip(*held))
            if not len(h):
                continue
            last = int(np.searchsorted(h, h[-1]))  # rows come sorted by h; the last anchor may go on
            if last:
                yield from work(h[:last], s[:last], doc[:last], place[:last], hot is not None and h[0] == hot)
                hot = None
            h, s, doc, place = h[last:], s[last:], doc[last:], place[last:]
            if len(h) > HELD_ROWS:  # reduce what is there, hold on to the firsts of each stretch
                order, gone, _ = reduce_stretches(h, s, doc, place, within)
                h, s, doc, place, hot = h[order], s[order], doc[order], place[order], h[0]
                yield _rows(GONE, h[gone], doc[gone], place[gone])
                h, s, doc, place = h[~gone], s[~gone], doc[~gone], place[~gone]
            held, size = [(h, s, doc, place)], len(h) if len(h) < HELD_ROWS // 8 else 0
        if held:
            h, s, doc, place = (np.concatenate(x) for x in zip(*held))
            yield from work(h, s, doc, place, hot is not None and len(h) > 0 and h[0] == hot)

    filed = rows.mapInArrow(file, SCHEMA).repartition("h").sortWithinPartitions("h").mapInArrow(reduce, SCHEMA)
    known = write_and_read(filed, "stretches")
    place = {"row": F.shiftright("place", 40).cast("int"), "start": F.shiftright("place", 8).bitwiseAND(F.lit(0xFFFFFFFF)),
             "n": F.col("place").bitwiseAND(F.lit(0xFF)).cast("int")}
    known = known.withColumns(place)
    whole = known.where(F.col("kind") == GONE).select("doc_id", "row", "start", (F.col("n") - 1 + method.WIDTH).alias("length"))
    left = known.where(F.col("kind") == STRETCH)
    full = write_and_read(left.groupBy("h").agg(F.sum(F.col("n") - 1 + method.WIDTH).alias("units")).where(
        F.col("units") > FULL_UNITS).select("h"), "full")  # one in FULL_UNITS units of the corpus at most
    some_full = not full.isEmpty()

    def texts_of(part):
        borders = part.groupBy("doc_id", "row").agg(F.collect_list(F.struct("h", "start", "n")).alias("stretches"))
        return packed(docs.where("doc_id is not null and text is not null")).join(borders, ["doc_id", "row"])

    def windows(batches):
        for block in unpacked(batches):
            lists = block.column("stretches")
            item = lists.flatten()
            text = np.repeat(np.arange(len(block)), np.diff(lists.offsets.to_numpy()))
            start, n = item.field("start").to_numpy(), item.field("n").to_numpy().astype(np.int64)
            text, start = np.repeat(text, n), np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            a, b = method.window_keys(block, text, start)
            doc, row = (block.column(c).to_numpy()[text] for c in ("doc_id", "row"))
            for lo in range(0, len(text), 1 << 14):
                cut = slice(lo, lo + (1 << 14))
                yield flat.records(["a", "b", "doc_id", "row", "start"], [
                    a[cut].view(np.int64), b[cut].view(np.int64), doc[cut], row[cut], start[cut]])

    def fetch(batches):
        for block in unpacked(batches):
            lists = block.column("stretches")
            item = lists.flatten()
            text = np.repeat(np.arange(len(block)), np.diff(lists.offsets.to_numpy()))
            start, n = item.field("start").to_numpy(), item.field("n").to_numpy()
            made = method.contents(block, text, start, n)
            size = COMPARE_BYTES
            for lo in range(0, len(text), 1 << 14):
                cut = slice(lo, lo + (1 << 14))
                yield flat.records(["h", "doc_id", "row", "start", "n", "content"], [
                    item.field("h")[cut], block.column("doc_id").to_numpy()[text[cut]], block.column("row").to_numpy()[text[cut]],
                    start[cut], n[cut], pa.array(made[cut], pa.binary())])

    def compare(batches):
        held, size = [], 0

        def work(t: pa.Table):
            h, doc, row, start, n = (t.column(c).to_numpy() for c in ("h", "doc_id", "row", "start", "n"))
            content = t.column("content").to_pylist()
            which, at, length = method.compare(h, doc, start, n, content, within)
            return flat.records(["doc_id", "row", "start", "length"], [
                doc[which], row[which], start[which] + at, length])

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                held.append(batch.slice(lo, 512))
                size += held[-1].nbytes
                if size >= COMPARE_BYTES:
                    t = pa.Table.from_batches(held)
                    h = t.column("h").to_numpy()
                    last = int(np.searchsorted(h, h[-1]))
                    if last:
                        yield work(t.slice(0, last))
                        held = t.slice(last).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held) if last else 0
        if held:
            yield work(pa.Table.from_batches(held))

    spans = "doc_id long, row int, start long, length long"
    content = texts_of(left.join(F.broadcast(full), "h", "left_anti") if some_full else left).mapInArrow(
        fetch, "h long, doc_id long, row int, start long, n int, content binary")
    partial = content.repartition("h").sortWithinPartitions("h").mapInArrow(compare, spans)
    out = whole.select("doc_id", "row", "start", F.col("length").cast("long").alias("length")).union(partial)
    if not some_full:
        return out
    # a window that very many texts share is one key: its first is found in parts, and the adaptive join splits the rest
    each = texts_of(left.join(F.broadcast(full), "h", "left_semi")).mapInArrow(windows, "a long, b long, doc_id long, row int, start long")
    each = write_and_read(each, "windows")
    first = each.groupBy("a", "b").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    later = F.col("doc_id") > F.col("first.doc_id")
    if within:
        later |= (F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") > F.col("first.start"))
    return out.union(each.join(first, ["a", "b"]).where(later).select("doc_id", "row", "start", F.lit(method.WIDTH).cast("long")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row, text; `row` tells texts of one doc_id apart."""
    return docs.select("doc_id", F.xxhash64("text").bitwiseAND(F.lit(ROW_BITS)).cast("int").alias("row"), "text")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, row and the text compressed, as it moves between tasks; a null text is an empty one."""
    def pack(batches):
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = [c.compress(t.encode()) if t else b"" for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=["doc_id", "row", "packed"])
    return keyed(docs).mapInArrow(pack, "doc_id long, row int, packed binary")


def unpacked(batches):
    """Blocks of packed rows, with their other columns."""
    d = zstandard.ZstdDecompressor()
    for b in batches:
        names = b.schema.names
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            texts = [d.decompress(x) if x else b"" for x in part.column(names.index("packed")).to_pylist()]
            part = pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.large_binary()) if n == "packed" else part.column(i) for i, n in enumerate(names)],
                names=["text" if n == "packed" else n for n in names])
            yield from flat.blocks(iter([part]), "text")


def rewrite(docs: DataFrame, method, within: bool, schema: str) -> DataFrame:
    """Every row of docs with its removed spans applied by `method.finish`."""
    if dict(docs.dtypes)["doc_id"] != "bigint":
        raise ValueError("doc_id must be a long")
    docs = flat.in_small_batches(docs)
    spans = removed(docs, method, within).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    rows = packed(docs).join(spans, ["doc_id", "row"], "left")

    def finish(batches):
        for block in unpacked(batches):
            lists = block.column("spans")
            offsets = np.zeros(len(block) + 1, np.int64)
            offsets[1:] = np.cumsum(flat.pc.fill_null(flat.pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            item = lists.flatten()
            text = np.repeat(np.arange(len(block)), np.diff(offsets))
            yield method.finish(block, text, item.field("start").to_numpy(), item.field("length").to_numpy())

    return rows.mapInArrow(finish, schema)


def cover(total: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    d = np.zeros(total + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:total]) > 0


def runs(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Maximal runs of true flags per text."""
    begin = flags.copy()
    begin[1:] &= ~flags[:-1]
    inner = bounds[:-1][bounds[1:] > bounds[:-1]]
    begin[inner] = flags[inner]
    return flat.sums(begin, bounds)

"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification and union-find grouping.

SuperMinHash gives each element of a set a random permutation of the signature's places and the values j + r at its
j-th place. All elements take their first step, then all their second, and so on; once every place of a text holds a
value below the next step's, no later step can lower one and the text is done. A large set stops after two or three.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from granulith.llm import flat
from granulith.llm.components import components
from granulith.session import write_and_read

SHINGLE = 5
#: 32 bands of 4 places: a pair at similarity 0.75 shares none with probability 5e-6.
BANDS, ROWS = 32, 4
PLACES = BANDS * ROWS
SIMILARITY = 75
#: Bytes of texts compared in one block of a group of candidates.
GROUP_BYTES = 3 << 20


def shingles(block: flat.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text in order of texts, and the words of each text."""
    words = flat.Words(block, flat.lower_table())
    h, n = words.hashes(), words.counts()
    at = np.flatnonzero(flat.window_starts(words.at, SHINGLE))
    text, value = words.text_of()[at], flat.window_hashes(h, SHINGLE)[at]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = flat.stretch(flat.prefix(h), words.at[short], words.at[short + 1])
        text, value = np.concatenate([text, short]), np.concatenate([value, whole])
    _, first = np.unique(flat.mix(value + flat.mix(text.astype(np.uint64) + flat.ONE)), return_index=True)
    first = first[np.argsort(text[first], kind="stable")]
    return text[first], value[first], n


def signatures(text: np.ndarray, value: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """SuperMinHash of n texts from the (text, element) pairs of their sets; places of an empty set stay at the maximum."""
    out = np.full((n, places), np.iinfo(np.int64).max, np.int64)
    flat_out, swaps = out.reshape(-1), []
    for j in range(places):
        if not len(text):
            break
        r = (flat.mix(value + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(16)).astype(np.int64)
        k = flat.mix(value ^ flat.mix(np.uint64(2 * j + 2))) >> np.uint64(32)
        k = j + ((k * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        place = k
        for t in range(j - 1, -1, -1):  # which place the swaps so far have put at k
            s = swaps[t]
            place = np.where(place == s, t, np.where(place == t, s, place))
        swaps.append(k)
        np.minimum.at(flat_out, text * places + place, (j << 48) + r)
        open_ = out.max(axis=1) >= (j + 1) << 48
        on = open_[text]
        if not on.all():
            text, value, swaps = text[on], value[on], [s[on] for s in swaps]
    return out


def _sign(batches):
    with np.errstate(over="ignore"):
        for block in flat.blocks(batches):
            text, value, _ = shingles(block)
            n = len(block)
            at = np.searchsorted(text, np.arange(n + 1))
            sig = signatures(text, value, n).reshape(n, BANDS, ROWS).astype(np.uint64)
            band = np.broadcast_to(flat.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (n, BANDS)).copy()
            for i in range(ROWS):
                band = flat.mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
            sets = []
            for seed in (1, 2):
                s = np.concatenate([[np.uint64(0)], np.cumsum(flat.mix(value + flat.mix(np.uint64(seed))), dtype=np.uint64)])
                sets.append((s[at[1:]] - s[at[:-1]]).view(np.int64))
            yield flat.records(["doc_id", "n_shingles", "n_bytes", "set_a", "set_b", "bands"], [
                block.column("doc_id"), np.diff(at), np.diff(block.bounds), *sets, flat.pa.FixedSizeListArray.from_arrays(
                    band.reshape(-1).view(np.int64), BANDS).cast(flat.pa.list_(flat.pa.int64()))])


def link_group(group: np.ndarray, text: np.ndarray, value: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what is linked: texts i with group[i] and the sets given by (text, value), by breadth-first
    search over an inverted index. A text is compared with those not reached yet only, so edges are fewer than texts."""
    n = len(group)
    size = np.bincount(text, minlength=n)
    key = flat.mix(value + flat.mix(group[text].astype(np.uint64)))
    _, element, df = np.unique(key, return_inverse=True, return_counts=True)
    # what stands in one text only can't be shared; a text with too much of it has no link
    shared = np.bincount(text, df[element] > 1, minlength=n)
    alive = 100 * shared >= SIMILARITY * size
    keep = alive[text] & (df[element] > 1)
    text, element = text[keep], element[keep]
    order = np.argsort(element, kind="stable")
    posting, at = text[order], np.searchsorted(element[order], np.arange(len(df) + 1))
    own, own_at = element, np.searchsorted(text, np.arange(n + 1))
    edges, waiting = [], alive.copy()
    for start in np.flatnonzero(alive).tolist():
        if not waiting[start]:
            continue
        waiting[start] = False
        queue = [start]
        while queue:
            v = queue.pop()
            e = own[own_at[v]:own_at[v + 1]]
            lens = at[e + 1] - at[e]
            ends = np.cumsum(lens)
            if not len(e):
                continue
            met = posting[np.repeat(at[e] - (ends - lens), lens) + np.arange(int(ends[-1]))]
            met = met[waiting[met]]
            if not len(met):
                continue
            other, both = np.unique(met, return_counts=True)
            near = other[100 * both >= SIMILARITY * (size[v] + size[other] - both)]
            waiting[near] = False
            queue += near.tolist()
            edges += [(v, x) for x in near.tolist()]
    return edges


def _verify(batches):
    """Rows (g1, g2, g3, doc_id, text) sorted by group; several whole groups are worked on at once."""
    held: list = []

    def links(rows: flat.pa.Table):
        keys = [rows.column(c).to_numpy() for c in ("g1", "g2", "g3")]
        change = np.zeros(rows.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        group, ids = np.cumsum(change), rows.column("doc_id").to_numpy()
        text, value, base = [], [], 0
        for block in flat.blocks(iter(rows.select(["text"]).combine_chunks().to_batches())):
            t, v, _ = shingles(block)
            text.append(t + base)
            value.append(v)
            base += len(block)
        edges = link_group(group, np.concatenate(text), np.concatenate(value))
        return flat.records(["a", "b"], [np.array([ids[x] for x, _ in edges], np.int64), np.array([ids[y] for _, y in edges], np.int64)])

    size = 0
    for batch in batches:
        lo = 0
        while lo < batch.num_rows:
            hi = min(batch.num_rows, lo + 64)
            held.append(batch.slice(lo, hi - lo))
            size += held[-1].nbytes
            lo = hi
            if size > 2 * GROUP_BYTES:
                rows = flat.pa.Table.from_batches(held)
                keys = [rows.column(c).to_numpy() for c in ("g1", "g2", "g3")]
                last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
                if len(last):  # all but the last group are whole
                    cut = int(last[-1]) + 1
                    yield links(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
    if held:
        yield links(flat.pa.Table.from_batches(held))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id it is linked with over any number of
    links), kept.

    Rows with one doc_id are one node. Null and empty texts, and texts without words, have no shingles and no links; rows without an id
    are linked with nothing, have a null component and are kept. Equal sets are linked by their digests, counted before
    the shuffle, and only one text of each takes part in the comparison. Bands that hold one text go; every other
    band's texts form a group named by its smallest id. A group is compared in blocks of bounded size, every pair of
    blocks in one task, and yields fewer links than it has texts.
    """
    if dict(docs.dtypes)["doc_id"] != "bigint":
        raise ValueError("doc_id must be a long")
    signed = write_and_read(flat.in_small_batches(docs).select("doc_id", "text").mapInArrow(
        _sign, "doc_id long, n_shingles long, n_bytes long, set_a long, set_b long, bands array<long>"), "signatures")
    filled = signed.where("doc_id is not null and n_shingles > 0")
    # counts are written, so that the joins with them have plain inputs and can split what very many texts share
    alike = write_and_read(filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "sets")
    copies = filled.join(alike, ["set_a", "set_b", "n_shingles"]).where("doc_id <> rep").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    one = filled.join(alike.select("set_a", "set_b", F.col("rep").alias("doc_id")), ["doc_id", "set_a", "set_b"], "left_semi")
    band = one.select("doc_id", "n_bytes", F.explode("bands").alias("h"))
    full = band.groupBy("h").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("h", "pivot")
    member = write_and_read(band.join(write_and_read(full, "bands"), "h").select("doc_id", "n_bytes", "pivot").distinct(), "members")
    blocks = write_and_read(member.groupBy("pivot").agg(F.ceil(F.sum("n_bytes") / GROUP_BYTES).cast("int").alias("n_blocks")), "blocks")
    placed = member.join(blocks, "pivot").withColumn("b", F.pmod(F.xxhash64("doc_id"), F.greatest("n_blocks", F.lit(1))).cast("int"))
    placed = placed.withColumn("x", F.explode(F.sequence(F.lit(0), F.greatest("n_blocks", F.lit(1)) - 1)))
    placed = placed.select("doc_id", F.col("pivot").alias("g1"), F.least("b", "x").alias("g2"), F.greatest("b", "x").alias("g3"))
    # the plan must not depend on the size: a small table of members would be sent around, a large one shuffled
    texts = docs.where("doc_id is not null").select("doc_id", "text").join(placed.hint("merge"), "doc_id")
    links = texts.select("g1", "g2", "g3", "doc_id", "text").repartition("g1", "g2", "g3").sortWithinPartitions(
        "g1", "g2", "g3").mapInArrow(_verify, "a long, b long")
    found = components(copies.union(links))
    out = signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

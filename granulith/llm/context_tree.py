"""Context-tree weighting over bytes, decomposed into binary decisions.

A text is scored as the bytes of its lower-cased words, joined by one space and closed by an end byte. Each byte is
eight binary decisions, and each decision node has a context tree of its own over the bytes before. A tree's node mixes
its own Krichevsky-Trofimov estimate half and half with the product of its children, from the deepest contexts to the
root, so all depths up to DEPTH take part and the corpus decides their weights.

Counts are of all training texts, and every context that stands in one has a node. The model is a table, never one
array: strings of DEPTH + 1 bytes are dealt out by their last two context bytes, below which a tree is whole within a
task, and what is left above are two levels of at most 256 contexts. Some megabytes of texts (a unit) send their
distinct strings to the tasks with these trees, packed, and get one number for each back.
"""

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from granulith.llm import flat
from granulith.session import write_and_read

DEPTH = 5
#: A context has a node if it stands before one in 2**SHARE training bytes: at 62, any that stands before one at all.
SHARE = 62
END = 255
#: Most frequent words whose counts every task gets; the counts of the others are joined.
TOP_WORDS = 1 << 16
#: Token that closes each text in the base model.
END_TOKEN = np.int64(0x454E44)
MERGE = 3 << 20
#: Bytes scored with one set of strings, and strings of whole trees worked on together.
UNIT_BYTES = 16 << 20
HELD_STRINGS = 1 << 18
#: Strings in one row of a request or of counts.
ROW_STRINGS = 1 << 13
#: Buckets are the upper bits of a 16-bit hash of the two context bytes before a byte (of a word: of the word itself).
BUCKET_BITS = 11
#: Counts below this have their log gamma in a table.
SMALL = 1 << 12
WORD, GRAM = 0, 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def stream(words: flat.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after DEPTH end bytes, and `at`: text i is at[i]:at[i + 1] but for the first DEPTH."""
    counts = words.counts()
    texts = len(counts)
    text, length = words.text_of(), words.end - words.start
    per_text = np.bincount(text, length, minlength=texts).astype(np.int64) + np.maximum(counts, 1) + DEPTH
    at = np.concatenate([[0], np.cumsum(per_text)])
    out = np.full(at[-1], END, np.uint8)
    before = np.cumsum(length) - length
    first = words.at[:-1][text]
    begin = at[text] + DEPTH + (before - before[np.minimum(first, len(before) - 1)]) + np.arange(len(text)) - first if len(text) else before
    inside = np.flatnonzero(words.inside)
    out[np.repeat(begin - before, length) + np.arange(len(inside))] = words.bytes[inside]
    last = np.zeros(len(text), bool)
    last[words.at[1:][counts > 0] - 1] = True
    out[(begin + length)[~last]] = 32
    return out, at


def _merged(parts):
    """One sorted (keys, counts) of several."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def strings(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each byte of the texts of `stream` below the DEPTH bytes before it, as a number, text by text. The latest byte stands
    first, so that sorted numbers keep the contexts of every depth together."""
    code = np.zeros(len(data) - DEPTH, np.int64)
    for j in range(DEPTH - 1, -1, -1):
        code = code << 8 | data[j:len(data) - DEPTH + j]
    code = code << 8 | data[DEPTH:]
    scored = np.ones(len(code), bool)  # the padding in front of each text is context only
    scored[(at[1:-1, None] - DEPTH + np.arange(DEPTH)).ravel()] = False
    return code[scored]


def _planes(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _pack(keys: np.ndarray) -> bytes:
    """Sorted numbers as compressed byte planes of their steps."""
    with np.errstate(over="ignore"):
        return _planes(np.diff(keys, prepend=0))


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(_numbers(packed))


def _bucket(keys: np.ndarray, kind: int) -> np.ndarray:
    own = keys >> 32 if kind == GRAM else keys
    return ((own & 65535) * 40503 & 65535) >> 16 - BUCKET_BITS


def _by_bucket(keys: np.ndarray, kind: int):
    """Stretches (bucket, places) of sorted distinct keys, at most ROW_STRINGS in each, sorted within."""
    bucket = _bucket(keys, kind)
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else []
    for lo, hi in zip(first, [*first[1:], len(keys)]):
        for at in range(lo, hi, ROW_STRINGS):
            yield int(bucket[lo]), order[at:min(hi, at + ROW_STRINGS)]


COUNTS = "kind int, bucket int, keys binary, n binary"


def _count_rows(kind: int, keys: np.ndarray, counts: np.ndarray):
    rows = [(bucket, _pack(keys[i]), _planes(counts[i])) for bucket, i in _by_bucket(keys, kind)]
    for lo in range(0, len(rows), 256):
        bucket, k, n = zip(*rows[lo:lo + 256])
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(k), pa.int32()), pa.array(bucket, pa.int32()), pa.array(k, pa.binary()),
                                          pa.array(n, pa.binary())], names=["kind", "bucket", "keys", "n"])


def counted(docs: DataFrame) -> DataFrame:
    """Packed counts (COUNTS): words by hash in the training texts and strings of DEPTH + 1 bytes in all texts, with their
    number in the training texts, summed in tasks, then by bucket."""
    def run(batches):
        parts = {WORD: [], GRAM: []}

        def rows(kind):
            keys, counts = _merged(parts[kind])
            parts[kind] = []
            yield from _count_rows(kind, keys, counts)

        for block in flat.blocks(batches):
            words = flat.Words(block, flat.lower_table())
            learn = ~block.column("held").to_numpy(zero_copy_only=False)
            if learn.any():
                k, n = np.unique(words.hashes().view(np.int64)[learn[words.text_of()]], return_counts=True)
                parts[WORD] += [(k, n), (np.array([END_TOKEN]), np.array([learn.sum()]))]
            data, at = stream(words)
            k, i = np.unique(strings(data, at), return_inverse=True)
            n = np.bincount(i, np.repeat(learn, np.diff(at) - DEPTH), minlength=len(k))
            parts[GRAM].append((k, n.astype(np.int64)))
            for kind in parts:
                if sum(len(k) for k, _ in parts[kind]) > MERGE:
                    parts[kind] = [_merged(parts[kind])]
                    if len(parts[kind][0][0]) > MERGE // 2:
                        yield from rows(kind)
        for kind in parts:
            if parts[kind]:
                yield from rows(kind)

    def join(batches):
        own, parts, size = None, [], 0
        for kind, bucket, rows in _runs(batches, "kind", "bucket"):
            if (kind, bucket) != own:
                if parts:
                    yield from _count_rows(own[0], *_merged(parts))
                own, parts, size = (kind, bucket), [], 0
            for k, n in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist()):
                parts.append((_unpack(k), _numbers(n)))
                size += len(parts[-1][0])
                if size > MERGE:
                    parts = [_merged(parts)]
                    size = len(parts[0][0]) // 2                  # merged again once half as much has come
        if parts:
            yield from _count_rows(own[0], *_merged(parts))

    made = docs.select("text", held_out(F.col("doc_id")).alias("held")).mapInArrow(run, COUNTS)
    return made.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(join, COUNTS)


def unpacked(counts: DataFrame, kind: int, name: str) -> DataFrame:
    """Rows (name, c) of packed counts."""
    def run(batches):
        for batch in batches:
            for k, n in zip(*(c.to_pylist() for c in batch.columns)):
                yield flat.records([name, "c"], [_unpack(k), _numbers(n)])

    return counts.where(F.col("kind") == kind).select("keys", "n").mapInArrow(run, f"{name} long, c long")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0 (Stirling's series after a shift by eight)."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - shift


_tables: dict[float, np.ndarray] = {}


def _log_gamma_of(count: np.ndarray, more: float) -> np.ndarray:
    """`log_gamma` of whole counts plus `more`, most of which are small."""
    if more not in _tables:
        _tables[more] = log_gamma(np.arange(SMALL) + more)
    out = _tables[more][np.minimum(count, SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(count >= SMALL)
    out[large] = log_gamma(count[large] + more)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives a zeros and b ones."""
    return _log_gamma_of(a, 0.5) + _log_gamma_of(b, 0.5) - _log_gamma_of(a + b, 1.0) - np.log(np.pi)


def _evidence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`log_kt`, exactly zero where nothing was counted."""
    out, on = np.zeros(a.shape), a + b > 0
    out[on] = log_kt(a[on], b[on])
    return out


def _mix(a, b, below, rest_a, rest_b):
    """Of nodes with counts a, b whose children give `below`: log probability, own share, estimate, estimate of the leaf
    that children without a node share."""
    own, half = _evidence(a, b), np.log(0.5)
    mixed = np.logaddexp(half + own, half + below + _evidence(rest_a, rest_b))
    return mixed, np.exp(half + own - mixed), (b + 0.5) / (a + b + 1), (rest_b + 0.5) / (rest_a + rest_b + 1)


def _trees(code: np.ndarray, n: np.ndarray, least: int):
    """Per bit of the last byte, the trees below contexts of two bytes: the strings' order, bit and row, and of each row
    (context of DEPTH bytes, bits before) its node of depth 2 and the probability of a one there.

    `code` has the strings of a context side by side. An order by the bits before alone keeps it so, and the contexts of
    every depth are runs of neighbours.
    """
    context, byte = code >> 8, code & 255
    big = {}
    for d in range(2, DEPTH + 1):
        short = context >> 8 * (DEPTH - d)
        first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
        big[d] = np.repeat(np.add.reduceat(n, first) >= least, np.diff(np.append(first, len(code))))
    for j in range(8):
        before = 1 << j | byte >> 8 - j
        order = np.argsort(before.astype(np.uint8), kind="stable") if j else np.arange(len(code))
        c, t, bit, count = context[order], before[order], (byte >> 7 - j & 1)[order], n[order]
        other, apart = t[1:] != t[:-1], c[1:] ^ c[:-1]
        first = {d: np.concatenate([[True], other | (apart >> 8 * (DEPTH - d) != 0)]) for d in range(2, DEPTH + 1)}
        at, row = np.flatnonzero(first[DEPTH]), np.cumsum(first[DEPTH]) - 1
        a, b = np.add.reduceat(count * (1 - bit), at), np.add.reduceat(count * bit, at)
        mixed, p, node, up = _evidence(a, b), (b + 0.5) / (a + b + 1), big[DEPTH][order[at]], np.arange(len(at))
        for d in range(DEPTH - 1, 1, -1):
            head = first[d][at]
            begin, i, rest = np.flatnonzero(head), np.cumsum(head) - 1, ~node
            below, rest_a, rest_b = (np.add.reduceat(x, begin) for x in (mixed * node, a * rest, b * rest))
            a, b = np.add.reduceat(a, begin), np.add.reduceat(b, begin)
            mixed, stay, estimate, leaf = _mix(a, b, below, rest_a, rest_b)
            deep, up = np.where(node[up], p, leaf[i[up]]), i[up]
            p = stay[up] * estimate[up] + (1 - stay[up]) * deep
            at = at[begin]
            node = big[d][order[at]]
        # of each node: its two context bytes, the later one first, and the bits before
        yield order, bit, row, up, p, c[at] >> 8 * (DEPTH - 2), t[at], a, b, mixed, node


def _whole_trees(batches):
    """(code, n) of all strings below some contexts of two bytes; rows come sorted by bucket."""
    held, size = [], 0
    for _, _, rows in _runs(batches, "bucket", "kind"):
        bucket = rows.column(rows.schema.names.index("bucket"))[0].as_py()
        if held and size >= HELD_STRINGS and bucket != held[-1][0]:
            yield np.concatenate([k for _, k, _ in held]), np.concatenate([n for _, _, n in held])
            held, size = [], 0
        for k, n in zip(*(rows.column(rows.schema.names.index(c)).to_pylist() for c in ("keys", "n"))):
            held.append((bucket, _unpack(k), _numbers(n)))
            size += len(held[-1][1])
    if held:
        yield np.concatenate([k for _, k, _ in held]), np.concatenate([n for _, _, n in held])


def _requests(unit: int, keys: np.ndarray):
    """(unit, bucket, keys) of a unit's sorted distinct strings."""
    for bucket, i in _by_bucket(keys, GRAM):
        yield unit, bucket, _pack(keys[i])


def _runs(batches, *names):
    """Stretches of a batch's rows with equal values of two columns: the values and a slice of the batch."""
    for batch in batches:
        x, y = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in names)
        cut = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        for lo, hi in zip([0, *cut], [*cut, len(x)]):
            if lo < hi:
                yield x[lo], y[lo], batch.slice(lo, hi - lo)


def _ordered(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings with those of a context side by side; parts of a bucket may come in any order."""
    order = np.argsort(code, kind="stable")
    return code[order], n[order]


def answers(counts: DataFrame, requests: DataFrame) -> DataFrame:
    """(unit, keys, p) for (unit, bucket, keys): log10 of the probability of each string's last byte after those before it."""
    grams = counts.where(F.col("kind") == GRAM)
    total = unpacked(counts, GRAM, "key").agg(F.sum("c")).first()[0] or 0 if SHARE < 62 else 0
    least = max(1, -(-total >> SHARE))

    def sums(batches):
        for code, n in _whole_trees(batches):
            for _, _, _, _, _, context, t, a, b, mixed, node in _trees(*_ordered(code, n), least):
                k, i = np.unique(context >> 8 << 8 | t, return_inverse=True)
                yield flat.records(["k", "a", "b", "mixed", "rest_a", "rest_b"], [k, *(
                    np.bincount(i, x, len(k)) for x in (a, b, mixed * node, a * ~node, b * ~node))])

    # at most 256 contexts of one byte with 255 decisions each
    got = grams.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        sums, "k long, a double, b double, mixed double, rest_a double, rest_b double").groupBy("k").agg(
        *(F.sum(c).alias(c) for c in ("a", "b", "mixed", "rest_a", "rest_b"))).toArrow()
    a, b, below, rest_a, rest_b = np.zeros((5, 256, 256))
    k = got.column("k").to_numpy()
    for x, name in ((a, "a"), (b, "b"), (below, "mixed"), (rest_a, "rest_a"), (rest_b, "rest_b")):
        x.reshape(-1)[k] = got.column(name).to_numpy()
    node = (a + b)[:, 1] >= least
    mixed, *one = _mix(a, b, below, rest_a, rest_b)
    rest = ~node[:, None]
    _, *root = _mix(a.sum(0), b.sum(0), (mixed * node[:, None]).sum(0), (a * rest).sum(0), (b * rest).sum(0))
    head = grams.sparkSession.sparkContext.broadcast((node, one, root))

    def logs(code, n):
        node1, (stay1, estimate1, leaf1), (stay0, estimate0, leaf0) = head.value
        out = np.zeros(len(code))
        for order, bit, row, up, p, context, t, _, _, _, node2 in _trees(code, n, least):
            c, t = (context >> 8)[up], t[up]
            p = stay1[c, t] * estimate1[c, t] + (1 - stay1[c, t]) * np.where(node2[up], p, leaf1[c, t])
            p = stay0[t] * estimate0[t] + (1 - stay0[t]) * np.where(node1[c], p, leaf0[t])
            out[order] += np.log10(np.where(bit == 1, p[row], 1 - p[row]))
        return out.astype(np.float32)

    def run(batches):
        bucket, parts, code, p = None, [], None, None
        for own, asked, rows in _runs(batches, "bucket", "asked"):
            if own != bucket:
                bucket, parts, code = own, [], None
            column = dict(zip(rows.schema.names, rows.columns))
            if not asked:
                parts += [(_unpack(k), _numbers(n)) for k, n in zip(column["keys"].to_pylist(), column["n"].to_pylist())]
                continue
            if code is None:
                code, n = _ordered(*(np.concatenate(x) for x in zip(*parts)))
                parts, p = [], logs(code, n)
            got = []
            for packed in column["keys"].to_pylist():
                keys = _unpack(packed)
                i = np.minimum(np.searchsorted(code, keys), len(code) - 1)
                if (code[i] != keys).any():
                    raise ValueError("a string that was not counted")
                got.append(p[i].tobytes())
            yield flat.records(["unit", "keys", "p"], [column["unit"], column["keys"], pa.array(got, pa.binary())])

    trees = grams.select("bucket", F.lit(False).alias("asked"), F.lit(0).cast("long").alias("unit"), "keys", "n")
    asked = requests.select("bucket", F.lit(True).alias("asked"), "unit", "keys", F.lit(None).cast("binary").alias("n"))
    return trees.union(asked).repartition("bucket").sortWithinPartitions("bucket", "asked").mapInArrow(
        run, "unit long, keys binary, p binary")


def _scored(batches):
    """Texts with the sum of their strings' logarithms; per unit, the answers come before its texts."""
    unit, parts, key, p = None, [], None, None
    d = zstandard.ZstdDecompressor()
    for own, is_text, rows in _runs(batches, "unit", "is_text"):
        if own != unit:
            unit, parts, key = own, [], None
        column = dict(zip(rows.schema.names, rows.columns))
        if not is_text:
            parts += zip(map(_unpack, column["keys"].to_pylist()), (np.frombuffer(x, np.float32) for x in column["p"].to_pylist()))
            continue
        if key is None:
            key, p = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key)
            key, p, parts = key[order], p[order], []
        field = {f.name: column["text"].field(f.name) for f in column["text"].type}
        data = [d.decompress(x) for x in field.pop("data").to_pylist()]
        at = np.cumsum([0, *map(len, data)])
        code = strings(np.frombuffer(b"".join(data), np.uint8), at)
        score = np.bincount(np.repeat(np.arange(len(data)), np.diff(at) - DEPTH), p[np.searchsorted(key, code)], len(data))
        yield flat.records([*field, "unit", "score"], [*field.values(), np.full(len(data), own), score])


def score(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score, score and code_length,
    the bits per byte.

    Texts of held out ids are not learned from. A null or empty text has the end alone; a null id is not held out;
    repeated rows count as often as they stand. Without training texts all decisions are even. The counts of the most
    frequent words reach every task; those of all others are joined per word and text.
    """
    spark = flat.in_small_batches(docs).sparkSession
    rows = docs.select("doc_id", "text")
    counts = write_and_read(counted(docs), "counts")
    words = unpacked(counts, WORD, "word")
    tokens, kinds = words.agg(F.sum("c"), F.count("*")).first()
    tokens, kinds = tokens or 0, kinds or 0
    ends = words.where(F.col("word") == int(END_TOKEN)).agg(F.sum("c")).first()[0] or 0  # known to every text, however rare
    top = words.where(F.col("word") != int(END_TOKEN)).orderBy(F.desc("c"), "word").limit(TOP_WORDS).toArrow()
    key, c = top.column("word").to_numpy(), top.column("c").to_numpy()
    order = np.argsort(key)
    most = spark.sparkContext.broadcast((key[order], c[order]))
    floor = float(np.log10(tokens + kinds + 1))
    rest = kinds - (ends > 0) > len(key)

    def run(batches):
        top, top_n = most.value
        unit, size, met, place = uuid.uuid4().int >> 65, 0, [], 0
        z = zstandard.ZstdCompressor(level=3)

        def ask():
            keys = np.unique(np.concatenate(met))
            rows = [{"unit": u, "bucket": k, "keys": x} for u, k, x in _requests(unit, keys)]
            for lo in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[lo:lo + 64], schema)

        for block in flat.blocks(batches):
            ws = flat.Words(block, flat.lower_table())
            n = len(block)
            h, text = ws.hashes().view(np.int64), ws.text_of()
            i = np.minimum(np.searchsorted(top, h), max(0, len(top) - 1))
            known = top[i] == h if len(top) else np.zeros(len(h), bool)
            gain = np.bincount(text[known], np.log10(top_n[i[known]] + 1.0), minlength=n) if len(top) else np.zeros(n)
            n_known = np.bincount(text[known], minlength=n)
            if ends:
                gain, n_known = gain + np.log10(ends + 1.0), n_known + 1
            data, at = stream(ws)
            met.append(np.unique(strings(data, at)))
            raw = data.tobytes()
            # words outside the top with their number in each text
            pair = np.flatnonzero(~known) if rest else np.zeros(0, np.int64)
            pair = pair[np.lexsort((h[pair], text[pair]))]
            head = np.ones(len(pair), bool)
            head[1:] = (h[pair[1:]] != h[pair[:-1]]) | (text[pair[1:]] != text[pair[:-1]])
            first = np.flatnonzero(head)
            tf = np.diff(np.append(first, len(pair)))
            last = pa.array(np.searchsorted(text[pair[first]], np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id"), pa.array(np.arange(place, place + n)), pa.array(ws.counts() + 1), pa.array(n_known), pa.array(gain),
                pa.array(np.diff(at) - DEPTH), pa.array([z.compress(raw[x:y]) for x, y in zip(at[:-1], at[1:])], pa.binary()),
                pa.array(np.full(n, unit)), pa.ListArray.from_arrays(last, pa.array(h[pair[first]])),
                pa.ListArray.from_arrays(last, pa.array(tf, pa.int32())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                schema=schema)
            size, place = size + len(data), place + n
            if size >= UNIT_BYTES:
                yield from ask()
                unit, size, met, place = uuid.uuid4().int >> 65, 0, [], 0
        if met:
            yield from ask()

    kind = dict(docs.dtypes)["doc_id"]
    own = f"doc_id {kind}, row long, n_tokens long, known long, gain double, n_bytes long"
    made = f"{own}, data binary, unit long, word array<long>, tf array<int>, bucket int, keys binary"
    schema = to_arrow_schema(_parse_datatype_string(made))
    both = write_and_read(rows.mapInArrow(run, made), "texts")
    texts = both.where("bucket is null")
    answered = answers(counts, both.where("bucket is not null").select("unit", "bucket", "keys"))
    text = F.struct("doc_id", "row", "n_tokens", "known", "gain", "n_bytes", "data")
    scored = texts.select("unit", F.lit(True).alias("is_text"), text.alias("text")).unionByName(
        answered.withColumn("is_text", F.lit(False)), allowMissingColumns=True)
    scored = scored.repartition("unit").sortWithinPartitions("unit", "is_text").mapInArrow(_scored, f"{own}, unit long, score double")
    # a text is its unit and its place there
    rare = texts.select("unit", "row", F.explode(F.arrays_zip("word", "tf")).alias("w")).select("unit", "row", "w.word", "w.tf")
    found = rare.join(words, "word").groupBy("unit", "row").agg(
        F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more_gain"), F.sum("tf").alias("more_known"))
    a, b = scored.alias("a"), found.alias("b")
    out = a.join(b, ["unit", "row"], "left")
    return out.select(
        "a.doc_id", held_out(F.col("a.doc_id")).alias("held_out"), "a.n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("gain") + F.coalesce("more_gain", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"), "a.score",
        (F.col("score") / -float(np.log10(2)) / F.col("n_bytes")).alias("code_length"))

import collections
import hashlib

import numpy as np
import pytest

from granulith.llm import components, line_chunks, superminhash, warc


def near(rows, words):
    """Classes by comparing all pairs of sets; rows of one id are one node."""
    sets, n_of = collections.defaultdict(list), []
    for i, t in rows:
        w = words(t, lower=True)
        s = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        n_of.append(len(s))
        if i is not None and s:
            sets[i].append(s)
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(i, n, None if i is None else root(i), i is None or root(i) == i) for (i, _), n in zip(rows, n_of)]


def test_near_duplicates(make_docs, corpus, words):
    got = [tuple(r) for r in superminhash.near_duplicates(make_docs(corpus)).collect()]
    assert sorted(got, key=repr) == sorted(near(corpus, words), key=repr)
    assert sum(not r[3] for r in got) >= 8
    assert superminhash.near_duplicates(make_docs([])).collect() == []


def test_large_group_in_blocks(make_docs, words, monkeypatch):
    """Near copies at all distances from one another, in many blocks, with links that only later members have."""
    monkeypatch.setattr(superminhash, "GROUP_BYTES", 2000)
    rng = np.random.default_rng(2)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 80, rng.integers(0, 6)):
            w[k] = f"x{rng.integers(0, 9)}"
        rows.append((int(1000 - i), " ".join(w)))
    got = [tuple(r) for r in superminhash.near_duplicates(make_docs(rows)).collect()]
    assert sorted(got) == sorted(near(rows, words))


def test_signature_against_the_plain_algorithm():
    """Element by element with its permutation carried along, as against all elements step by step."""
    from granulith.llm import flat
    rng, m = np.random.default_rng(4), 16
    text = np.sort(rng.integers(0, 5, 60))
    value = rng.integers(0, 2**63, 60).astype(np.uint64)
    want = np.full((6, m), np.iinfo(np.int64).max)
    for t, v in zip(text, value):
        p = list(range(m))
        for j in range(m):
            r = int(flat.mix(np.uint64(v) + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) >> 16
            k = int(flat.mix(np.uint64(v) ^ flat.mix(np.uint64(2 * j + 2)))) >> 32
            k = j + (k * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            want[t, p[j]] = min(want[t, p[j]], (j << 48) + r)
    with np.errstate(over="ignore"):
        assert (superminhash.signatures(text, value, 6, m) == want).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 900).astype(np.uint64)
    text = np.repeat([0, 1], 600)
    s = superminhash.signatures(text, np.concatenate([x[:600], x[300:]]), 2, 512)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.08


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, k) for k in range(1001, 1300)] + [(7000, 6000), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    want = {i: 0 for i in range(401)} | {i: 1000 for i in range(1000, 1300)} | {7000: 6000, 6000: 6000}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def chunk(text):
    """The rule of the boundaries, line by line."""
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [(h[i] + 31 * (h[i - 1] if i > 0 else 0) + 961 * (h[i - 2] if i > 1 else 0)) % line_chunks.MODULUS for i in range(len(h))]
    out, own = [], []
    for i, x in enumerate(lines):
        own.append(x)
        if i == len(lines) - 1 or (i > 0 and r[i] < r[i - 1] and r[i] <= r[i + 1]):
            out += [own[k:k + line_chunks.MOST_LINES] for k in range(0, len(own), line_chunks.MOST_LINES)]
            own = []
    return ["\n".join(c) for c in out]


def brute_lines(rows):
    first = {}
    for i, t in rows:
        if i is not None and t is not None:
            for no, c in enumerate(chunk(t)):
                first[c] = min(first.get(c, (i, no)), (i, no))
    out = []
    for i, t in rows:
        cs = [] if t is None else chunk(t)
        gone = [i is not None and "\n" in c and first[c] < (i, no) for no, c in enumerate(cs)]
        out.append((i, sum(c.count("\n") + 1 for c in cs), len(cs), sum(gone), sum(c.count("\n") + 1 for c, g in zip(cs, gone) if g),
                    None if t is None else "\n".join(c for c, g in zip(cs, gone) if not g)))
    return out


def test_line_chunks(make_docs, corpus):
    rows = corpus + [(400, "\n".join(["same"] * 40)), (401, "\n\n\n"), (402, "x\n" + (corpus[9][1] or ""))]
    got = [tuple(r) for r in line_chunks.dedup(make_docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute_lines(rows), key=repr)
    assert sum(r[3] for r in got) > 10
    kept = line_chunks.apply(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((r[0], r[5]) for r in got), key=repr)
    assert line_chunks.dedup(make_docs([])).collect() == []


def test_line_chunks_run_no_python(make_docs, corpus):
    plan = line_chunks.dedup(make_docs(corpus))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.fixture
def pages(spark):
    long = "<html>" + "péage " * 300
    rows = [(1, "http://a/", long), (2, "http://b/", long), (3, None, "short"), (4, "http://c/ \r\n", "short"), (5, "u", None), (6, "u", ""),
            (7, "u", "é" * 499 + "a"), (8, "u", "é" * 499 + "a"), (9, "u", "é" * 500), (10, "u", "é" * 500), (None, "u", long),
            (2, "again", long), (11, "u", "big" * 100000)]
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, digest string, refers_to string")


def test_archives_round_trip(pages):
    archives = warc.write(pages)
    got = warc.read(archives).collect()
    want = []
    rows = [(r.page_id, r.html or "") for r in pages.collect()]
    for i, html in rows:
        raw = html.encode()
        top = max(j for j, x in rows if x == html and j is not None)
        again = len(raw) >= 1000 and i is not None and i < top
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None,
                     None if again else raw))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload)
                    if r.payload is None or r.payload else b"") for r in got), key=repr) == sorted(want, key=repr)
    assert archives.agg({"n_records": "sum"}).first()[0] == len(rows)
    assert warc.read(warc.write(pages.limit(0))).collect() == []


def test_a_page_fetched_twice_keeps_both_payloads(spark):
    long, other, lone = "a" * 2000, "b" * 1500, "c" * 1200
    rows = [(1, long), (2, long), (1, other), (3, other), (1, "short"), (1, lone)]
    got = warc.read(warc.write(spark.createDataFrame([(i, "u", x) for i, x in rows], "page_id long, url string, html string"))).collect()
    want = [(1, "revisit", 2, None), (2, "response", None, long), (1, "revisit", 3, None), (3, "response", None, other),
            (1, "response", None, "short"), (1, "response", None, lone)]
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload and bytes(r.payload).decode()) for r in got), key=repr) == sorted(want, key=repr)



def test_records_are_frames_of_their_own():
    import io

    import zstandard
    records = [warc.record(i, "http://x/", b"payload %d " % i * 40, "0" * 40, None) for i in range(300)]
    frames, offsets = warc.archive(records)
    raw = b"".join(frames)
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_FRAME
    d = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8:offsets[0]]))
    for i in (0, 7, 299):
        assert zstandard.ZstdDecompressor(dict_data=d).decompress(raw[offsets[i]:]) == records[i]
    assert warc.open_archive(io.BytesIO(raw)).read() == b"".join(records)
    alone = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert sum(map(len, frames[1:])) < alone / 2

"""Packing, hard negatives and importance resampling against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from granulith.llm import hard_negatives, importance, packing

MODEL = public_tokenizers.path("word_bpe_49k.json")


# --- packing -------------------------------------------------------------------------
def _tokens(texts, end=1):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(MODEL)
    return [tok.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def _checked(rows, docs, longest=2048):
    """Every token once and in place, windows gapless and exactly filled."""
    want = Counter((i, tuple(t)) for (i, _), t in zip(docs, _tokens([t for _, t in docs])))
    windows, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        windows[r.sequence_id].append((r.offset, r.length, r.tier))
        parts[r.doc_id, r.doc_tokens].append((r.start, ids))
    for w in windows.values():
        place = 0
        for offset, length, tier in sorted(w):
            assert offset == place and tier == w[0][2]
            place += length
        assert place == tier <= longest and tier & (tier - 1) == 0
    got = Counter()
    for (i, n), ps in parts.items():
        for same in _copies(sorted(ps)):
            ids = [t for _, x in same for t in x]
            assert len(ids) == n
            got[i, tuple(ids)] += 1
    assert got == want
    return windows


def _copies(ps):
    """Pieces of documents that share id and length, put together start after end."""
    out = []
    for start, ids in ps:
        if start == 0:
            out.append([(0, ids)])
        else:
            next(o for o in out if sum(len(x) for _, x in o) == start).append((start, ids))
    return out


ODD = ["", None, " \t\n", "It's we'll  THE\x1cend", "<|endoftext|> a<|startoftext|>b", "café café ΣΑΣ İstanbul 12345",
       "a b c\x85d", "x" * 3000, "\x00 \x00", "naïve!!! ??x9"]


def test_tokens_by_word(spark, make_docs, corpus):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + k, t) for k, (_, t) in enumerate(corpus)]
    rows = packing.pack(make_docs(docs).repartition(3), MODEL).collect()
    _checked(rows, docs)
    by = {r.doc_id: r for r in rows if r.start == 0}
    assert by[0].doc_tokens == by[1].doc_tokens == by[2].doc_tokens == 1


def test_pack_odd_rows(spark, make_docs):
    """Null ids and repeated rows are rows of their own; one row; an empty table."""
    docs = [(None, "one two"), (None, None), (5, "three"), (7, "four five six")]
    _checked(packing.pack(make_docs(docs).coalesce(1), MODEL).collect(), docs)
    rows = packing.pack(make_docs([(3, "same text")] * 40).repartition(5), MODEL).collect()
    assert len({r.sequence_id for r in rows}) == len({(r.tier, r.sequence_id) for r in rows}) and sum(r.length for r in rows) == 120
    assert packing.pack(make_docs([]), MODEL).count() == 0
    assert packing.pack(make_docs([(1, None)]), MODEL).count() == 1


def test_pack_over_many_tasks(spark, make_docs):
    """Leftovers of over FAN tasks meet level by level; a very long text spans many windows."""
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "Delta,"]) for _ in range(r.randint(0, 900)))) for i in range(150)]
    docs.append((1000, "long text " * 150_000))
    rows = packing.pack(make_docs(docs).repartition(40, "doc_id"), MODEL).collect()
    windows = _checked(rows, docs)
    assert sum(1 for w in windows.values() if w[0][2] < 256) <= 8
    assert {w[0][2] for w in windows.values()} >= set(packing.TIERS)


def test_fill_prefers_whole_remainders():
    windows, rest = packing.fill([1500, 548, 1000, 24, 200, 56, 2048 * 2 + 256])
    assert not rest and sorted(t for t, _ in windows) == [256, 256, 1024, 2048, 2048, 2048]
    assert sum(len(w) for _, w in windows) == 10 - 1
    load = Counter()
    windows = [(2048, [])] * 33 + [(256, [])] * 70
    for (t, _), s in zip(windows, packing.steps(windows, 16384)):
        load[s] += t
    assert max(load.values()) - min(load.values()) <= 2048 + 256


# --- hard negatives ------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<double>, label int, part string, kind string, score string"


def _plain(rows, every=10, k=5, n=10):
    ok = sorted({(i, l, tuple(math.floor(256 * x) for x in v)) for i, v, l in rows if i is not None and l is not None and v is not None
                 and all(x is not None and math.isfinite(x) and abs(x) <= 2 ** 20 for x in v)})
    out = Counter()
    for a in (r for r in ok if r[0] % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r) for r in ok if r != a and len(r[2]) == len(a[2]))
        for p in [(-s, i) for s, i, r in scored if r[1] == a[1]][:k]:
            found = [(-s, i) for s, i, r in scored if r[1] != a[1] and 30 * p[0] <= -100 * s <= 90 * p[0]][:n]
            for rank, (s, i) in enumerate(found, 1):
                out[a[0], p[1], rank, i, p[0], s] += 1
    return out


@pytest.mark.parametrize("part_rows", [40, 10_000])
def test_mine(spark, part_rows):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, .2) + (i % 4 == 0) * .1 for _ in range(6)], r.randint(0, 3)) for i in range(300)]
    rows += [(1000 + i, [0.25, -0.125, 0.5, 0.0, 0.25, 0.1], i % 2) for i in range(60)]                    # one vector, tied scores
    rows += [(2000, [0.0] * 6, 1), (2010, [1.0, 2.0], 0), (2011, [1.0, 1.0], 0), (2012, [0.5, 0.75], 1), (2020, [], 0)]
    rows += [(None, [.1] * 6, 1), (2030, None, 1), (2040, [.1] * 6, None), (2050, [.1, None, .1, .1, .1, .1], 1), (2060, [float("nan")] * 6, 1),
             (2070, [float("inf")] * 6, 1), (2080, [1e300] * 6, 1), (2090, [1e6, -1e6, 3.0, 0., 0., 1.], 1), (2091, [9e5, 1e6, 1., 0., 0., 1.], 1),
             (2092, [5e5, 1e5, 1., 0., 0., 1.], 2), rows[0], rows[0], (10, [.3] * 6, 2)]
    df = spark.createDataFrame([(i, v, l, "x", "x", "x") for i, v, l in rows], VECTORS)
    got = Counter(tuple(x) for x in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, part_rows=part_rows).collect())
    assert got == _plain(rows) and len(got) > 200


def test_mine_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, "", "", "")], VECTORS)
    assert hard_negatives.mine(alone, F.col("vec_id") % 10 == 0).count() == 0


def test_visit_stops_early():
    """Few rows are scored where one component decides, and the answer is that of a scan."""
    g = np.random.default_rng(1)
    x = g.integers(-40, 40, (5000, 8))
    x[:, 0] = g.permutation(5000) * 10
    lists, best, met = hard_negatives.Lists(np.arange(5000), np.zeros(5000, np.int64), x), hard_negatives.Best(10), []
    a = np.array([9, 1, -1, 2, 0, 0, 3, 1])

    def take(rows, scores, threshold):
        met.append(len(rows))
        best.add(scores, lists.ids[rows])
        return threshold is not None and best.closed(threshold)

    lists.visit(a, take)
    scores = x @ a
    assert sum(met) < 2500 and best.ids.tolist() == np.lexsort((np.arange(5000), -scores))[:10].tolist()


# --- importance resampling -----------------------------------------------------------
def _features(text):
    import re
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def _resampled(docs, target, percent=25, least=20):
    s, t = (Counter(b for x in texts for b in _features(x)[1]) for texts in ([x for _, x in docs], target))
    ns, nt = s.total(), t.total()
    rows = []
    for i, x in docs:
        words, f = _features(x)
        g = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in f]
        weight = sum(g) // len(g) if g else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2 ** 32))), len(words)))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[4], r[1], r[2]))
    k = len(able) * percent // 100
    out = Counter((*r[:4], n if n <= k else None) for n, r in enumerate(able, 1))
    return out + Counter((*r[:4], None) for r in rows if r[4] < least)


def test_resample(spark, make_docs, corpus):
    docs = corpus + [(200 + i, f"{corpus[i][1]} end {'w' * (i * 7)} tail") for i in range(20)] + [(500, "HOT line one two " * 9)] * 30
    target = [t for _, t in corpus[:9]] + [None, ""]
    df = make_docs(docs).repartition(5)
    got = importance.resample(df, make_docs([(i, t) for i, t in enumerate(target)]), percent=40)
    assert Counter(tuple(r) for r in got.collect()) == _resampled(docs, target, 40)


def test_resample_nothing(spark, make_docs):
    none = make_docs([])
    assert importance.resample(none, none).count() == 0
    few = importance.resample(make_docs([(1, "one two"), (2, None), (None, "")]), none).collect()
    assert len(few) == 3 and all(r["rank"] is None for r in few)


def test_copies_of_one_key(spark):
    """One key with more copies than are unfolded at a time, cut by the draw."""
    n = importance.COPIES * 2 + 5
    rows = spark.range(n).select(F.lit(9).cast("long").alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(59).cast("long").alias("n_features"),
                                 F.lit(3).cast("long").alias("weight"), F.lit(8).cast("long").alias("score"))
    out = importance.draw(rows, percent=50)
    assert out.count() == n and [r[0] for r in out.select("rank").where("rank is not null").orderBy("rank").collect()] == list(range(1, n // 2 + 1))


def test_kth_key_against_sorting(spark):
    r = random.Random(2)
    rows = [(r.randint(-5, 5), i is None, i, 30, r.randint(1, 3), 0) for i in [*range(400), *range(100), None, None]]
    keys = spark.createDataFrame([(*k, 1 + n % 3) for n, k in enumerate(sorted(set(rows), key=repr))],
                                 "neg_score long, no_id boolean, doc_id long, n_words long, n_features long, weight long, copies long")
    flat = sorted(((*x[:6],) for x in keys.collect() for _ in range(x.copies)), key=lambda k: tuple(0 if c is None else c for c in k))
    for k in (1, 2, len(flat) // 3, len(flat)):
        assert tuple(importance.kth_key(keys, k, pivots=3)) == flat[k - 1]


def test_crc_of_long_words():
    import pyarrow as pa
    from granulith.llm import flat
    texts = ["ab " + "y" * 63 + " " + "z" * 64 + " " + "q" * 65 + " ü" * 3 + " " + "p" * 5000 + " a", "solo", ""]
    block = next(flat.blocks([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    w, one, two, joined = importance._features(block, flat.letters_table(), importance.Crc(), 4294967291)
    assert sorted(one.tolist() + two[joined].tolist()) == sorted(zlib.crc32(f.encode()) % 4294967291 for t in texts for x in [t.split()]
                                                                 for f in x + [f"{a} {b}" for a, b in zip(x, x[1:])])

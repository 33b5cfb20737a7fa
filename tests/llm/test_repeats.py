import hashlib

import numpy as np
import pytest

from granulith.llm import flat, recompression, repeats, run_index


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_bytes(rows, width=100):
    """Windows by (doc_id, start); rows of one id are one place."""
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for s in range(len(b) - width + 1):
                k = b[s:s + width]
                first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if i is not None and first[b[s:s + width]] < (i, s):
                gone[s:s + width] = [True] * width
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), len(b) - len(left), spans, sha(left)))
    return out


def brute_words(rows, words, width=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - width + 1):
            if i is not None:
                k = tuple(w[s:s + width])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if i is not None and first[tuple(w[s:s + width])] < i:
                gone[s:s + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def test_bytes_against_brute_force(make_docs, corpus):
    got = [tuple(r)[:5] for r in run_index.dedup(make_docs(corpus)).collect()]
    assert sorted(got, key=repr) == sorted(brute_bytes(corpus), key=repr)
    assert sum(r[2] for r in got) > 1000


def test_words_against_brute_force(make_docs, corpus, words):
    got = [tuple(r)[:4] for r in recompression.dedup(make_docs(corpus)).collect()]
    assert sorted(got, key=repr) == sorted(brute_words(corpus, words), key=repr)
    assert sum(r[2] for r in got) > 500


@pytest.mark.parametrize("op", [run_index.dedup, recompression.dedup])
def test_empty_table(make_docs, op):
    assert op(make_docs([])).collect() == []


def test_one_hot_passage_with_other_neighbours(make_docs, words):
    """Every text holds one passage between words of its own: many stretches under one anchor."""
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(i, f"a{i} b{i} " * 9 + passage + f" c{i} d{i}" * 9) for i in range(300)]
    assert sorted(tuple(r)[:4] for r in recompression.dedup(make_docs(rows)).collect()) == sorted(brute_words(rows, words))
    assert sorted(tuple(r)[:5] for r in run_index.dedup(make_docs(rows)).collect()) == sorted(brute_bytes(rows))


def test_anchors_with_more_rows_than_are_held(make_docs, corpus, words, monkeypatch):
    """Reduction and comparison in small parts find what they find at once."""
    monkeypatch.setattr(repeats, "HELD_ROWS", 8)
    monkeypatch.setattr(repeats, "COMPARE_BYTES", 2000)
    got = [tuple(r)[:5] for r in run_index.dedup(make_docs(corpus)).collect()]
    assert sorted(got, key=repr) == sorted(brute_bytes(corpus), key=repr)
    got = [tuple(r)[:4] for r in recompression.dedup(make_docs(corpus)).collect()]
    assert sorted(got, key=repr) == sorted(brute_words(corpus, words), key=repr)


def test_reduction_keeps_the_first_of_each_stretch():
    rng = np.random.default_rng(1)
    n = 5000
    h, s = np.sort(rng.integers(0, 3, n)), rng.integers(0, 40, n)
    doc, place = rng.integers(0, 50, n), rng.integers(0, 9, n) << 8 | 5
    order, gone, compare = repeats.reduce_stretches(h, s, doc, place, True)
    first = {}
    for a, b, d, p in zip(h, s, doc, place):
        first[a, b] = min(first.get((a, b), (d, p >> 8)), (d, p >> 8))
    want = [(d, p >> 8) > first[a, b] for a, b, d, p in zip(h[order], s[order], doc[order], place[order])]
    assert gone.tolist() == want
    assert (compare == ~gone).all()


def test_index_streams_all_match_lengths():
    rng = np.random.default_rng(5)
    parts = [bytes(rng.choice(list(b"ab"), 150)) for _ in range(6)]
    parts += [parts[0][20:140], parts[1][:100] + parts[2][:60]]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    data = np.frombuffer(b"".join(parts), np.uint8)
    got = run_index.Index(data, bounds, np.arange(len(data))).matching()
    ends = [int(bounds[np.searchsorted(bounds, i, "right")]) for i in range(len(data))]
    raw = data.tobytes()

    def common(i, j):
        k = 0
        while i + k < ends[i] and j + k < ends[j] and raw[i + k] == raw[j + k]:
            k += 1
        return k
    for i in range(0, len(data), 7):
        true = max(common(i, j) for j in range(len(data)) if j != i)
        assert true - 8 < got[i] <= true


def test_names_do_not_depend_on_the_surroundings():
    """The names over the middle of a window are the same wherever it stands."""
    rng = np.random.default_rng(3)
    window = rng.integers(0, 4, recompression.WIDTH).astype(np.uint64)

    def middle(before, after):
        tokens = flat.mix(np.concatenate([before, window, after]).astype(np.uint64))
        length, first = np.ones(len(tokens), np.int64), np.zeros(len(tokens), bool)
        first[0] = True
        for number, cap in enumerate(recompression.ROUNDS):
            tokens, length, first = recompression.rename(tokens, length, first, cap, number)
        name, begin = np.repeat(tokens, length), np.repeat(np.cumsum(length) - length, length) - len(before)
        at = slice(len(before) + recompression.MARGIN, len(before) + recompression.WIDTH - recompression.MARGIN)
        return name[at].tolist(), begin[at].tolist()
    seen = {str(middle(rng.integers(0, 4, k), rng.integers(0, 4, 29 - k))) for k in range(30)}
    assert len(seen) == 1


@pytest.mark.parametrize("limit", [0, 400])
def test_overfull_anchors_are_split_by_window(make_docs, corpus, words, monkeypatch, limit):
    """No task compares more of one anchor than the limit; the windows that are split off give the same spans."""
    monkeypatch.setattr(repeats, "FULL_UNITS", limit)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = corpus + [(1000 + i, f"a{i} b{i} " * 9 + passage + f" c{i} d{i}" * 9) for i in range(40)]
    if not limit:  # every anchor is over-full, so a comparison would be of a whole anchor
        for op in (run_index, recompression):
            monkeypatch.setattr(op.Method, "compare", staticmethod(lambda *a: 1 / 0))
    got = [tuple(r)[:5] for r in run_index.dedup(make_docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute_bytes(rows), key=repr)
    got = [tuple(r)[:4] for r in recompression.dedup(make_docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute_words(rows, words), key=repr)

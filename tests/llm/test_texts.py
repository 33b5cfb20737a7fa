import collections
import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from granulith.llm import context_tree, flat, prefix_viterbi, rule_ledger, toxicity, wu_manber
from granulith.llm.queries import TOKENIZER


def block(texts):
    return next(flat.blocks(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})])))


def test_words_and_hashes(corpus, words):
    texts = [t for _, t in corpus]
    b = block(texts)
    w = flat.Words(b, flat.lower_table())
    raw = w.bytes.tobytes()
    got = [[raw[w.start[i]:w.end[i]].decode() for i in range(w.at[k], w.at[k + 1])] for k in range(len(texts))]
    assert got == [words(t, lower=True) for t in texts]
    h = w.hashes().tolist()
    flat_words = [x for ws in got for x in ws]
    assert len(set(zip(flat_words, h))) == len(set(flat_words)) == len(set(h))


def test_blocks_keep_rows_whole():
    texts = ["ab" * 40, None, "", "c" * 300, "d"]
    got = [x.data.tobytes().decode() for x in flat.blocks(iter([pa.RecordBatch.from_pydict({"text": texts})]), most=100)]
    assert "".join(got) == "".join(t or "" for t in texts) and max(map(len, got)) == 300


def brute_rules(text, words):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    count = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    rep = {k for i in range(len(w) - 4) if count[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(rep),
            sum("A" <= c <= "Z" for c in text))


def test_ledger(make_docs, corpus, words):
    rows = corpus + [(200, "### |a| $5 <b>"), (201, "HELLO WORLD " * 9)]
    got = rule_ledger.ledger(make_docs(rows)).collect()
    want = [(i, *brute_rules(t, words)) for i, t in rows]
    assert sorted((tuple(r)[:8] for r in got), key=repr) == sorted(want, key=repr)
    by = {r.doc_id: r.failed for r in got}
    assert by[100] == 1 and by[201] & 1 << 5 and by[200] & 1 << 2
    assert rule_ledger.ledger(make_docs([])).collect() == []


def test_policies_and_ablations(make_docs, corpus):
    rows = rule_ledger.ledger(make_docs(corpus))
    bits = [r.failed for r in rows.collect()]
    for version, rules in rule_ledger.POLICIES.items():
        mask = rule_ledger.mask(rules)
        assert rows.where(rule_ledger.passes(version)).count() == sum(not b & mask for b in bits)
        for r in rule_ledger.ablations(rows, version).collect():
            b = 1 << rule_ledger.RULES.index(r.rule)
            assert (r.n_rows, r.n_failed, r.n_kept_without) == (
                len(bits), sum(bool(x & b) for x in bits), sum(not x & mask & ~b for x in bits))


def brute_score(train, text, words, end="\xff"):
    """Context-tree weighting by recursion, every decision's tree on its own."""
    def data(t):
        return b"\xff" * context_tree.DEPTH + " ".join(words(t, lower=True)).encode() + b"\xff"
    d = context_tree.DEPTH
    total = sum(len(data(t)) - d for t in train)
    seen = [(x[i - d:i], x[i]) for t in train for x in [data(t)] for i in range(d, len(x))]
    frequent = collections.Counter(c[d - k:] for c, _ in seen for k in range(d + 1))
    node = {c for c, n in frequent.items() if n << context_tree.SHARE >= total} | {b""}

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def tree(pairs, ctx, path):
        """(log weighted probability, probability of a one) below ctx; path: the full context asked for."""
        a, b = sum(1 - bit for _, bit in pairs), sum(bit for _, bit in pairs)
        own, p = kt(a, b), (b + .5) / (a + b + 1)
        if len(ctx) == d:
            return own, p
        parts = collections.defaultdict(list)
        for c, bit in pairs:
            k = c[d - len(ctx) - 1:]
            parts[k if k in node else None].append((c, bit))
        mine = path[d - len(ctx) - 1:]
        mine = mine if mine in node else None
        below, deep = 0.0, .5
        for k in set(parts) | {None, mine}:
            v = tree(parts[k], k, path) if k is not None else (
                kt(sum(1 - x for _, x in parts[k]), sum(x for _, x in parts[k])),
                (sum(x for _, x in parts[k]) + .5) / (len(parts[k]) + 1))
            below += v[0]
            deep = v[1] if k == mine else deep
        mixed = np.logaddexp(math.log(.5) + own, math.log(.5) + below)
        stay = math.exp(math.log(.5) + own - mixed)
        return mixed, stay * p + (1 - stay) * deep

    x, out = data(text), 0.0
    for i in range(d, len(x)):
        for j in range(8):
            pairs = [(c, y >> (7 - j) & 1) for c, y in seen if y >> (8 - j) == x[i] >> (8 - j)]
            p = tree(pairs, b"", x[i - d:i])[1]
            out += math.log10(p if x[i] >> (7 - j) & 1 else 1 - p)
    return out


def test_context_tree_against_recursion(make_docs, words, monkeypatch):
    monkeypatch.setattr(context_tree, "SHARE", 5)
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The dog", "on the cat", "a mat a mat a mat", "the the the",
                                         "cat on dog", "mat", "sat sat", None, "dog on  mat\n", "", "q"])]
    rows += [(None, "the cat"), (3, "a mat a mat a mat")]
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for t in train for w in words(t, lower=True) + ["\xff"])
    n, v = sum(counts.values()), len(counts)
    got = context_tree.score(make_docs(rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    assert any(r.held_out for r in got) and {r.train_tokens for r in got} == {n}
    for r in got:
        own = words(text[r.doc_id], lower=True) + ["\xff"]
        assert (r.n_tokens, r.n_known) == (len(own), sum(counts[w] > 0 for w in own))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert r.score == pytest.approx(brute_score(train, text[r.doc_id], words), rel=1e-4)


def test_context_tree_without_texts(make_docs, monkeypatch):
    monkeypatch.setattr(context_tree, "TOP_WORDS", 2)
    assert context_tree.score(make_docs([])).collect() == []
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = context_tree.score(make_docs([(only, "ab")])).first()
    assert r.held_out and r.n_known == 0 and r.score == pytest.approx(24 * math.log10(.5))
    many = context_tree.score(make_docs([(i, "a b c d e f") for i in range(9)] + [(None, "a z")])).collect()
    assert {r.n_known for r in many if r.doc_id is not None} == {7} and [r.n_known for r in many if r.doc_id is None] == [3]


def test_encoding_is_the_library_s(make_docs, corpus):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    rows = corpus + [(300, "  two  spaces "), (301, "tab\there 日本 🙂\x00"), (302, "mark ▁ here"), (303, " "), (304, "a" * 3000)]
    docs = make_docs(rows)
    got = prefix_viterbi.encode(docs, TOKENIZER, check=True)
    want = sorted(((i, None if t is None else sp.encode(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=repr) == want
    assert all(r.round_trip == (r.doc_id != 302) and r.n_tokens == len(r.ids or []) for r in got.collect())
    back = sorted(((r.doc_id, r.text) for r in prefix_viterbi.decode(got, TOKENIZER).collect()), key=repr)
    assert back == sorted(((i, t and t.replace("▁", " ")) for i, t in rows), key=repr)
    assert prefix_viterbi.encode(make_docs([]), TOKENIZER).collect() == []


def test_what_a_task_holds_does_not_follow_its_batch(corpus):
    """A batch of as many characters as four blocks: arrays of decoded bytes and lists of words are those of one block."""
    texts = [t for _, t in corpus if t]
    texts = (texts * (1 + (1 << 21) // sum(map(len, texts))))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    enc = prefix_viterbi.Encoder(prefix_viterbi.read_model(TOKENIZER))
    enc.block(sorted(set(texts)))                                # the vocabulary and the words, which stay
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in prefix_viterbi._encoded(enc, batch, ["doc_id", "n_tokens", "ids", "round_trip"]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and most < 30e6


def test_unigram_paths_have_the_best_score():
    from sentencepiece import sentencepiece_model_pb2 as pb
    spec = pb.ModelProto.FromString(prefix_viterbi.read_model(TOKENIZER))
    spec.trainer_spec.model_type = prefix_viterbi.UNIGRAM
    v = prefix_viterbi.Vocabulary(spec.SerializeToString())
    trie = prefix_viterbi.Trie(v)

    def best(word):
        score = [0.0] + [-1e18] * len(word)
        for i in range(1, len(word) + 1):
            for j in range(i):
                s = v.score[v.pieces[word[j:i]]] if word[j:i] in v.pieces else v.unknown_score if j == i - 1 else -1e18
                score[i] = max(score[i], score[j] + s)
        return score[-1]
    for w in sorted(["▁there", "▁the", "▁thereupon", "▁x", "▁xylo", "▁inter", "▁international", "日", "▁日本"]):
        ids, total = trie.encode(w), 0.0
        for i in ids:
            total += v.score[i] if i in v.text else 0
        unknown = sum(c not in v.pieces for c in w)
        assert total + unknown * v.unknown_score == pytest.approx(best(w))


def brute_hits(text, items):
    words = [w.decode() for w in wu_manber.item_words(text)]
    hit, found = set(), set()
    for item, t in items:
        p = [w.decode() for w in wu_manber.item_words(t)]
        m = min(10, len(p))
        for k in range(len(p) - m + 1 if p else 0):
            for i in range(len(words) - m + 1):
                if words[i:i + m] == p[k:k + m]:
                    hit.update(range(i, i + m))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("passes", [False, True])
def test_benchmark_search(make_docs, spark, corpus, monkeypatch, passes):
    if passes:
        monkeypatch.setattr(wu_manber, "PASS_BYTES", 300)
    long = corpus[67][1] or ""
    w = long.split()
    items = [(1, " ".join(w[100:125])), (2, " ".join(w[110:121]).upper()), (10, w[300]), (3, " ".join(w[400:409])), (4, None), (5, "..."),
             (6, "never seen here"), (2, " ".join(w[500:530])), (None, w[7])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.hits), r["items"])
                  for r in wu_manber.occurrences(make_docs(corpus), bench).collect()), key=repr)
    want = sorted(((i, *brute_hits(t, items[:-1])) for i, t in corpus), key=repr)
    assert got == want and any(r[2] for r in got)
    clean = wu_manber.keep_clean(make_docs(corpus), bench)
    assert clean.count() == sum(not r[2] for r in want) and clean.columns == make_docs(corpus).columns
    none = spark.createDataFrame([], bench.schema)
    assert wu_manber.occurrences(make_docs(corpus), none).where("size(hits) > 0").count() == 0


def toxic_rows(n=600):
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 300, rng.integers(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.integers(1, len(words))] = ["idiot", "moron", "scum"][i % 3]
            if rng.random() < 0.7:
                words[0] = "muslims"
        elif rng.random() < 0.05:
            words[0] = "christians"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out_and_swaps(make_docs, spark):
    rows, labels = toxic_rows()
    docs, lab = make_docs(rows + [(None, "x"), (9000, None), (9001, "")]), spark.createDataFrame(
        labels + [(1, 0), (None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    got = toxicity.score(docs, model).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and all(r.predicted == truth[r.doc_id] for r in held)
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    empty = {r.doc_id: r.score for r in got if r.doc_id in (9000, 9001)}
    assert empty[9000] == empty[9001] < 0.5
    # neutral mentions: the term itself must not matter
    probe = toxicity.score(make_docs([(1, "muslims like w1"), (2, "christians like w1"), (3, "we like w1"), (4, "muslims are scum")]), model)
    s = {r.doc_id: r.score for r in probe.collect()}
    assert max(s[1], s[2], s[3]) < 0.3 and abs(s[1] - s[2]) < 0.05 and s[4] > 0.5
    # without the penalty the term, which toxic texts name more often, moves the score more
    data = toxicity.fit_rows(docs, lab).toArrow()
    lists = data.column("slots").combine_chunks()
    free = toxicity.train(data.column("toxic").to_numpy(), lists.offsets.to_numpy(), lists.flatten().to_numpy(), swap_weight=0.0)
    slot = int(toxicity._slots(["muslims"])[0])
    weight = [float(m.weights[np.searchsorted(m.slots, slot)]) for m in (model, free)]
    assert abs(weight[0]) < abs(weight[1])
    assert toxicity.keep_clean(docs, model).count() == sum(r.predicted == 0 for r in got)


def test_toxicity_fit_is_the_optimum(monkeypatch):
    """The slope of the loss, summed over plain texts and their swapped copies one by one, is zero at the fitted weights."""
    monkeypatch.setattr(toxicity, "IDENTITY", [["women", "men", "girls"], ["deaf", "blind"]])
    r = np.random.default_rng(3)
    texts = [set(r.choice(["good", "bad", "ugly", "women", "men", "deaf", "day", "sun"], r.integers(1, 6)).tolist()) for _ in range(80)]
    toxic = np.array([int("bad" in t or ("men" in t and r.random() < .6)) for t in texts])
    slot = dict(zip(names := ["good", "bad", "ugly", "women", "men", "girls", "deaf", "blind", "day", "sun"], toxicity._slots(names).tolist()))
    lists = [sorted(slot[w] for w in t) for t in texts]
    model = toxicity.train(toxic, np.cumsum([0, *map(len, lists)]), np.concatenate(lists))
    w = dict(zip(model.slots.tolist(), model.weights.tolist()))
    z = lambda t: model.intercept + sum(w.get(slot[x], 0.0) for x in t)
    y, n1 = toxic, toxic.sum()

    def slope(word):
        total = sum((1 / (1 + math.exp(-z(t))) - y[i]) for i, t in enumerate(texts) if word in t)
        for group in toxicity.IDENTITY:
            for t in texts:
                for a in set(group) & t:
                    copies = [t - {a} | {b} for b in group if b != a] + [t - {a}]     # swapped for each other term, and without
                    total += toxicity.SWAP_WEIGHT / 2 * sum((z(c) - z(t)) * ((word in c) - (word in t)) for c in copies)
        held = np.array([word in t for t in texts])
        p = held.mean()
        se = math.sqrt(p * (1 - p) * (1 / n1 + 1 / (len(y) - n1))) if 0 < p < 1 else 1e-6
        evidence = abs(held[y == 1].mean() - held[y == 0].mean()) / se
        strength = toxicity.RIDGE * (max(1.0, toxicity.EVIDENCE / max(evidence, 1e-3)) ** 2 if held.any() else 1.0)
        return total + strength * w.get(slot[word], 0.0)

    assert any({"women", "men"} <= t for t in texts) and len(w) >= 9
    assert max(abs(slope(word)) for word in names) < 0.02 and w[slot["bad"]] > 1.0


def test_toxicity_without_labels(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(make_docs([(1, "a")]), none)
    assert {r.score for r in toxicity.score(make_docs([(1, "a"), (2, None)]), model).collect()} == {0.5}
    assert toxicity.score(make_docs([]), model).collect() == []


def test_context_tree_keeps_rare_contexts(make_docs, words):
    learn, ask = ([i for i in range(400) if (zlib.crc32(str(i).encode()) % 7 == 2) == out] for out in (False, True))
    rows = [(learn[0], "qzxvk"), *((i, "aaaa" * 200) for i in learn[1:201]), (ask[0], "qzxvk"), (ask[1], "zxvkj aa")]
    got = {r.doc_id: r.score for r in context_tree.score(make_docs(rows)).collect()}

    def by_depth(text):
        """The recursion of `brute_score` on counts; every context that stands in a training text has a node."""
        count = collections.Counter()
        for i, t in rows:
            x = b"\xff" * 5 + t.encode() + b"\xff"
            count.update((x[k - 5:k], x[k]) for k in range(5, len(x)) if i in learn)
        kt = lambda a, b: math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

        def tree(pairs, d, path):
            a, b = (sum(n for _, y, n in pairs if y == v) for v in (0, 1))
            if d == 5 or not pairs:
                return kt(a, b), (b + .5) / (a + b + 1)
            below, deep = 0.0, .5
            for k in {c[4 - d:] for c, _, _ in pairs}:
                v = tree([x for x in pairs if x[0][4 - d:] == k], d + 1, path)
                below, deep = below + v[0], v[1] if k == path[4 - d:] else deep
            mixed = np.logaddexp(math.log(.5) + kt(a, b), math.log(.5) + below)
            stay = math.exp(math.log(.5) + kt(a, b) - mixed)
            return mixed, stay * (b + .5) / (a + b + 1) + (1 - stay) * deep

        x, out = b"\xff" * 5 + text.encode() + b"\xff", 0.0
        for i in range(5, len(x)):
            for j in range(8):
                pairs = [(c, y >> 7 - j & 1, n) for (c, y), n in count.items() if y >> 8 - j == x[i] >> 8 - j]
                p = tree(pairs, 0, x[i - 5:i])[1]
                out += math.log10(p if x[i] >> 7 - j & 1 else 1 - p)
        return out

    for i, t in rows[-2:] + rows[:1]:
        assert got[i] == pytest.approx(by_depth(t), rel=1e-6)


def test_end_is_known_beside_any_list_of_words(make_docs, monkeypatch):
    monkeypatch.setattr(context_tree, "TOP_WORDS", 1)
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2)
    r = context_tree.score(make_docs([(only, "a a a b b c")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (7, 7, 7)
    assert r.base_score == pytest.approx(math.log10(4) * 3 + math.log10(3) * 2 + math.log10(2) * 2 - 7 * math.log10(7 + 4 + 1))

import random

import pytest

DOCS = "doc_id long, text string, kept string, n_words string, h string, row string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) with further columns whose names clash with results."""
    def build(rows):
        return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], DOCS)
    return build


@pytest.fixture(scope="session")
def corpus():
    """A small corpus: nulls, empty and long texts, copies, near copies, shared passages, runs, repeated rows."""
    r = random.Random(7)
    words = ["".join(r.choice(["th", "er", "on", "an", "é", "re", "in", "st"]) for _ in range(r.randint(1, 3))) for _ in range(400)]

    def text(n):
        out = [r.choice(words) for _ in range(n)]
        for i in range(r.randint(5, 12), n, r.randint(7, 15)):
            out[i] += r.choice([".\n", ". ", ",\n"])
        return " ".join(out).replace("\n ", "\n")

    passage, rows = text(90), []
    for i in range(60):
        kind = i % 6
        if kind == 0 or not rows:
            t = text(r.randint(3, 300))
        elif kind == 1:
            t = rows[r.randrange(len(rows))][1] or ""
        elif kind == 2:
            w = (rows[r.randrange(len(rows))][1] or "").split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        elif kind == 3:
            t = text(r.randint(5, 60)) + "\n" + passage + "\n" + text(r.randint(5, 60))
        elif kind == 4:
            t = " ".join([r.choice(words)] * r.randint(1, 200))
        else:
            t = "The Same Line\nand Another\n" + text(20) + "\nThe Same Line\nand Another\n"
        rows.append((i * 3 % 61, t))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one two three"), (104, "ONE TWO three"), (105, "a" * 500),
             (106, "a" * 500), (107, text(4000)), (None, rows[0][1]), (None, None), rows[3], rows[3]]
    return rows


def words_of(text, lower=False):
    import re
    text = text or ""
    if lower:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.fixture(scope="session")
def words():
    return words_of

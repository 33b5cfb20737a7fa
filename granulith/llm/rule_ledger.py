"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit beside the measurements.

Policies are masks over the bits and are applied afterwards, without the texts; ablations (what a policy would keep
without one of its rules) are bitwise aggregates of the ledger.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from granulith.llm import flat

#: Bit of each rule in `failed`.
RULES = ["few_words", "repeated_windows", "many_symbols", "repeated_lines", "word_length", "shouting"]
#: Versioned policies: the rules each enforces. The ledger stays as it is when a version is added.
POLICIES = {1: ["few_words", "repeated_windows"],
            2: ["few_words", "repeated_windows", "many_symbols", "repeated_lines", "word_length", "shouting"]}
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]


def _repeats(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each (doc, value): how many equal ones there are."""
    key = flat.mix(value + flat.mix(doc.astype(np.uint64) + flat.ONE))
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[where]


def measure_block(block: flat.Block) -> list[np.ndarray]:
    """The measurements of each text of a block, in the order of MEASURES."""
    words, data, bounds = flat.Words(block, flat.plain_table()), block.data, block.bounds
    n_words, n = words.counts(), len(data)
    chars = flat.sums(words.inside & ((data & 0xC0) != 0x80), bounds)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    n_symbols = flat.sums(symbol[data], bounds)
    n_upper = flat.sums((data >= 65) & (data <= 90), bounds)
    # lines: from a text's start or after a newline, to the next newline or the text's end
    newline = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([bounds[:-1], newline + 1]))
    end = np.sort(np.concatenate([newline, bounds[1:]]))
    inside = np.zeros(n + 1, np.int64)
    np.cumsum(words.inside, out=inside[1:])
    worded = inside[end] > inside[start]
    start, end = start[worded], end[worded]
    # a text's lines follow each other, so the text of a line is found by its start
    doc = np.searchsorted(bounds, start, "right") - 1
    lines = flat.stretch(flat.prefix(flat.BYTE_VALUE[data]), start, end)
    n_lines = np.bincount(doc, minlength=len(block))
    key = flat.mix(lines + flat.mix(doc.astype(np.uint64) + flat.ONE))
    _, first = np.unique(key, return_index=True)
    n_dup = n_lines - np.bincount(doc[first], minlength=len(block))
    # windows found twice or more in their text cover their words
    window = flat.window_hashes(words.hashes(), WINDOW)
    at = np.flatnonzero(flat.window_starts(words.at, WINDOW))
    text = words.text_of()
    twice = at[_repeats(text[at], window[at]) > 1] if len(at) else at
    n_repeat = flat.sums(flat.covered(twice, WINDOW, len(words)), words.at)
    return [n_words, chars, n_symbols, n_lines, n_dup, n_repeat, n_upper]


def _measure(batches):
    for block in flat.blocks(batches):
        yield flat.records(["doc_id", *MEASURES],
                           [block.column("doc_id"), *[np.asarray(m, np.int64) for m in measure_block(block)]])


def failures() -> dict[str, Column]:
    """When each rule fails, over the measurements; integer arithmetic, so that every engine agrees."""
    c = F.col
    return {
        "few_words": c("n_words") < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "many_symbols": 10 * c("n_symbols") > c("n_words"),
        "repeated_lines": 2 * c("n_dup_lines") > c("n_lines"),
        "word_length": (2 * c("word_chars") < 5 * c("n_words")) | (c("word_chars") > 12 * c("n_words")),
        "shouting": 2 * c("n_upper") > c("word_chars"),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the measurements and `failed`, the bits of RULES that fail.

    Null and empty texts measure 0 everywhere and fail few_words only. Repeated rows and null ids are rows like others;
    further columns of docs are not read. No row needs another, so nothing is shuffled.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    measured = flat.in_small_batches(docs).select("doc_id", "text").mapInArrow(_measure, schema)
    rules = failures()
    bits = [F.when(rules[r], F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed", total.cast("long"))


def mask(rules: list[str]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def passes(version: int) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def ablations(ledger_rows: DataFrame, version: int, keys: list[str] | None = None) -> DataFrame:
    """For a policy: rows, kept rows, and per rule the rows that fail it at all, fail it alone (and would be kept
    without it); one row per rule and group of `keys`. Partial sums are combined before the shuffle."""
    keys = keys or []
    bits = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long"))
    aggs = [F.count("*").alias("n_rows"), F.sum((bits == 0).cast("long")).alias("n_kept"),
            F.bit_or(bits).alias("ever_failed")]
    for r in POLICIES[version]:
        b = 1 << RULES.index(r)
        aggs += [F.sum((bits.bitwiseAND(F.lit(b).cast("long")) != 0).cast("long")).alias(f"f_{r}"),
                 F.sum((bits == b).cast("long")).alias(f"o_{r}")]
    one = ledger_rows.groupBy(*keys).agg(*aggs)
    rows = F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"),
                                       F.col(f"o_{r}").alias("n_failed_alone"),
                                       (F.col("n_kept") + F.col(f"o_{r}")).alias("n_kept_without"))
                              for r in POLICIES[version]]))
    return one.select(*keys, "n_rows", "n_kept", "ever_failed", rows)

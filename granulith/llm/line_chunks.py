"""Line deduplication by content-defined chunks of lines, in DataFrame functions only.

Every line is hashed; a rolling hash over the last lines decides where chunks end: where it has a local minimum, so an
insertion moves only the boundaries near it and chunks have two lines at least (but for the last of a text). Chunks of
several lines that also stand earlier (smaller doc_id, or earlier in the same text) are removed after their whole texts
have been compared.
"""

from pyspark.sql import Column, DataFrame, functions as F

from granulith.session import write_and_read

#: Weights of the line and the lines before it in the rolling hash, and its modulus.
FACTORS = [1, 31, 961]
MODULUS = 4294967291
#: A stretch without a boundary is cut after so many lines.
MOST_LINES = 8


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks_of(text: Column) -> Column:
    """array<string>: the chunks of a text, which joined by newlines are the text again; null for a null text."""
    def roll(lines):
        hashes = F.transform(lines, line_hash)
        return F.transform(F.array(hashes), lambda h: F.transform(h, lambda x, i: (
            x * FACTORS[0] + F.when(i > 0, F.get(h, i - 1) * FACTORS[1]).otherwise(F.lit(0))
            + F.when(i > 1, F.get(h, i - 2) * FACTORS[2]).otherwise(F.lit(0))) % MODULUS))[0]

    def ends(r):
        n = F.size(r)
        return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (
            (i > 0) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) <= F.get(r, i + 1))))

    def parts(e):
        # (first line, lines) of each stretch between boundaries, long ones cut
        return F.flatten(F.transform(e, lambda b, k: F.transform(
            F.array(F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1) + 1)),
            lambda a: F.transform(F.sequence(a, b, F.lit(MOST_LINES)),
                                  lambda s: F.struct(s.alias("s"), F.least(F.lit(MOST_LINES), b - s + 1).alias("n"))))[0]))

    # lambdas over one-element arrays bind what is used many times, so that it is computed once per text
    return F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.transform(
        F.array(roll(lines)), lambda r: F.transform(F.array(ends(r)), lambda e: F.transform(
            parts(e), lambda c: F.array_join(F.slice(lines, c["s"] + 1, c["n"]), "\n")))[0])[0])[0]


def _lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def removed_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, gone array<int>): numbers of the chunks of a text that also stand earlier."""
    own = docs.where("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("row_hash"), F.posexplode(chunks_of(F.col("text"))).alias("no", "chunk"))
    own = own.where(F.contains("chunk", F.lit("\n"))).withColumn("h", F.xxhash64("chunk"))
    # written, so that the join below has plain inputs on both sides and can split a hash that very many chunks have;
    # the joins are the same at every size, where a small table of hashes would be sent around instead
    again = write_and_read(own.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    # written once: both sides below read it, and the first of each chunk is combined before the shuffle
    found = write_and_read(own.join(again.hint("merge"), "h", "left_semi"), "chunks")
    # the chunk itself is a key: equal hashes of different texts stay apart
    first = found.groupBy("h", "chunk").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count("*").alias("n"))
    first = write_and_read(first.where("n > 1").drop("n"), "firsts")
    later = found.join(first.hint("merge"), ["h", "chunk"]).where(F.struct("doc_id", "no") > F.col("first"))
    return later.groupBy("doc_id", "row_hash").agg(F.collect_set("no").alias("gone"))


def _cut(docs: DataFrame) -> DataFrame:
    """docs with `_chunk_gone`, the numbers of the chunks to remove (null for none); joined per text, not per id."""
    gone = removed_chunks(docs).select(F.col("doc_id").alias("_chunk_doc"), F.col("row_hash").alias("_chunk_row"), F.col("gone").alias("_chunk_gone"))
    on = (F.col("doc_id") == F.col("_chunk_doc")) & (F.xxhash64("text") == F.col("_chunk_row"))
    return docs.join(gone.hint("merge"), on, "left").drop("_chunk_doc", "_chunk_row")


def _chosen(keep: bool) -> Column:
    """The chunks that stay, or those that go."""
    return F.filter(chunks_of(F.col("text")), lambda c, i: F.array_contains("_chunk_gone", i) != F.lit(keep))


def apply(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows as they were, with the removed chunks cut out of `text`. See `dedup`."""
    text = F.when(F.col("_chunk_gone").isNull(), F.col("text")).otherwise(F.array_join(_chosen(True), "\n"))
    return _cut(docs).withColumn("text", text).select(docs.columns)


def dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_chunks, n_removed_chunks, n_removed_lines (long), and text, what is left.

    The first occurrence of a chunk stays; chunks of one line always stay. Null texts stay null with zero counts, empty
    texts stay empty. Rows without an id keep their text and remove nothing from others. Repeated rows with one id are
    one place: none removes the other's chunks. Further columns are not read. A chunk that most documents share is
    combined before the shuffle; where its rows meet for the comparison they are joined, not gathered.
    """
    zero = F.lit(0).cast("long")
    lost = F.when(F.col("_chunk_gone").isNull(), zero).otherwise(F.aggregate(_chosen(False), zero, lambda n, c: n + _lines(c)))
    return _cut(docs.select("doc_id", "text")).select(
        "doc_id", F.coalesce(_lines(F.col("text")).cast("long"), zero).alias("n_lines"),
        F.when(F.col("text").isNull(), zero).otherwise(F.size(chunks_of(F.col("text"))).cast("long")).alias("n_chunks"),
        F.when(F.col("_chunk_gone").isNull(), zero).otherwise(F.size("_chunk_gone").cast("long")).alias("n_removed_chunks"),
        lost.alias("n_removed_lines"),
        F.when(F.col("_chunk_gone").isNull(), F.col("text")).otherwise(F.array_join(_chosen(True), "\n")).alias("text"))

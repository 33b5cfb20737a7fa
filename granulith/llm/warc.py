"""WARC archives whose records are compressed one by one with a Zstandard dictionary of their own archive.

Each archive begins with a skippable frame that holds the dictionary, built from records of that archive; every record
is a frame of its own, so it can be read by offset with the dictionary alone.
"""

import hashlib
import io
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from granulith.llm import flat
from granulith.session import join_lookup, scratch_path, write_and_read

#: Frame that carries a dictionary in front of the records.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Payload bytes of an archive's first records that its dictionary is built from.
SAMPLE_BYTES = 4 << 20
#: Payload bytes gathered before an archive is closed; a larger record gets an archive of its own size.
ARCHIVE_BYTES = 16 << 20
LEAST_REVISIT = 1000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def roles(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat a payload of at least `least` bytes of a larger page_id."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.where("page_id is not null").select("page_id", F.sha1(payload).alias("digest"), F.length(payload).alias("n"))
    own = own.where(F.col("n") >= least)
    keeper = own.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1")
    # only digests and ids move; a payload that many pages share is split by the adaptive join
    return own.join(keeper, ["digest", "n"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if refers_to is not None else http + payload
    target = "".join(c if c > " " else "%%%02X" % ord(c) for c in url) if url else f"urn:x-page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary; where there are too few records to train on, their beginning serves as raw content."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r)
        size += len(r)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), sample, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def archive(records: list[bytes]) -> tuple[list[bytes], list[int]]:
    """The frames of an archive, the dictionary's first, and the offset of each record."""
    raw = dictionary(records)
    packed = zstandard.ZstdCompressor(level=19).compress(raw)
    frames = [DICTIONARY_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed]
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    offsets, at = [], len(frames[0])
    for r in records:
        frames.append(c.compress(r))
        offsets.append(at)
        at += len(frames[-1])
    return frames, offsets


def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per page (page_id, url, html) and return the archives: path, n_records, n_bytes.

    Of pages of equal payload of at least 1000 bytes the largest page_id is a response and the others revisit it;
    shorter payloads, and pages without an id, are always responses. A null html is an empty payload, a null url is
    replaced by a name made from the id; repeated rows each get a record; no pages give no archives. An archive's name
    is new in every attempt of a task, and only archives listed by the attempt that ended count, so lost executors
    leave unlisted files, never half-read ones.
    """
    spark = flat.in_small_batches(pages).sparkSession
    folder = folder or scratch_path(spark, "warc")
    # rows of one id may hold different payloads, each with a role of its own
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"))
    rows = rows.join(roles(pages), ["page_id", "digest"], "left")

    def close(records, count):
        filesystem, path = _filesystem(folder)
        filesystem.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        frames, _ = archive(records)
        with filesystem.open_output_stream(f"{path}/{name}") as out:
            for f in frames:
                out.write(f)
        return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_records": count, "n_bytes": sum(map(len, frames))}])

    def run(batches):
        records, size = [], 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                records.append(record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), refers_to))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield close(records, len(records))
                    records, size = [], 0
        if records:
            yield close(records, len(records))

    listed = rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, n_records bigint, n_bytes bigint")
    return write_and_read(listed, "warc-list")


def parse(stream) -> dict | None:
    """The next record's headers, and its block under "block"; None at the end."""
    line = stream.readline()
    while line == b"\r\n":
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        k, _, v = line.partition(b": ")
        out[k.decode()] = v.decode()
    out["block"] = stream.read(int(out["Content-Length"]))
    return out


def open_archive(source) -> io.BufferedReader:
    """The records of an archive as one stream, read with the dictionary in its first frame."""
    head = source.read(8)
    if int.from_bytes(head[:4], "little") != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(source.read(int.from_bytes(head[4:], "little")))
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    return io.BufferedReader(d.stream_reader(source, read_across_frames=True), 1 << 16)


def read(archives: DataFrame) -> DataFrame:
    """Records of the listed archives: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload
    (null for revisits). An archive is read as a stream, record by record."""
    number = "case when startswith(%s, '<urn:x-page:') then try_cast(substring(%s, 13, length(%s) - 13) as bigint) end"

    def run(batches):
        names = ["record_id", "url", "record_type", "payload_digest", "payload_bytes", "refers", "payload"]
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                filesystem, path = _filesystem(uri)
                with filesystem.open_input_stream(path) as source:
                    stream, rows, size = open_archive(source), [], 0
                    while (r := parse(stream)) is not None:
                        http, _, payload = r["block"].partition(b"\r\n\r\n")
                        n = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        revisit = r["WARC-Type"] == "revisit"
                        rows.append(dict(zip(names, [r["WARC-Record-ID"], r["WARC-Target-URI"], r["WARC-Type"],
                                                     r["WARC-Payload-Digest"].removeprefix("sha1:"), n,
                                                     r.get("WARC-Refers-To"), None if revisit else payload])))
                        size += len(payload)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    # archives are dealt out one by one, since each is as much work as a whole input split
    out = archives.select("path").repartition(F.col("path")).mapInArrow(
        run, "record_id string, url string, record_type string, payload_digest string, payload_bytes bigint, refers string, "
             "payload binary")
    return out.select(F.expr(number % (("record_id",) * 3)).alias("page_id"), "url", "record_type", "payload_digest",
                      "payload_bytes", F.expr(number % (("refers",) * 3)).alias("refers_to"), "payload")

"""WARC archives with revisit resolution.

Writing goes through Spark's own text sink: a record's header and payload are
one string, the record separator is the sink's line separator, so the files are
plain WARC (in gzip), reach any file system that Spark reaches, and appear only
when their task commits.  A file is closed once it holds ``FILE_BYTES``.

Revisits: headers (id, url, digest, size; no payload) are shuffled by payload
digest.  Of each digest the row with the smallest id is the original, the others
become ``revisit`` records, which are written from the headers alone.  A digest
that fills a third of the table is spread over sub-keys of about ``SALT_ROWS``
rows before it is grouped, and meets one row per sub-key that occurs.

Payloads stay where they are read.  A filter of fixed size (``_WORDS`` words of 64
bits, the only thing broadcast) tells which digests may repeat; the payload of any
other is written by the task that reads it.  Those that may repeat are grouped by
digest, map side first, so that one payload per digest and task is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise, new_path

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
END = CRLF + CRLF
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Rows of the table for each sub-key that a payload's rows are spread over.
SALT_ROWS = 2_000
#: Bytes of records (before compression) after which a file is closed.
FILE_BYTES = 32_000_000
#: 64-bit words of the filter of repeated digests, at most; a false hit only costs a shuffle.
_WORDS = 1 << 20
_KEY = ["digest", "size", "proof"]


def base32_sha1(payload):
    """Column: SHA-1 of a binary column in upper-case base32 (160 bits, no padding)."""
    digits = F.sha1(payload)
    letters = []
    for i in range(8):  # 5 hexadecimal digits are 4 letters
        twenty = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(twenty, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _payload(payload_col: str):
    return F.coalesce(F.col(payload_col), F.lit("")).cast("binary")


def _digested(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``id, url, digest, size, proof, p`` of every row; ``p`` is the payload, null ones count as empty.

    ``proof`` is a second, independent digest: payloads are called equal only
    when both digests and the size agree.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), _payload(payload_col).alias("p"))
    return rows.select("id", "url", base32_sha1(F.col("p")).alias("digest"), F.octet_length("p").cast("long").alias("size"), F.sha2("p", 256).alias("proof"), "p")


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``id, url, digest, size, proof`` of every row and its ``number``, which no two rows share."""
    return _digested(pages, id_col, url_col, payload_col).drop("p").withColumn("number", F.monotonically_increasing_id())


def _first(*more):
    """The original of a group: the smallest id (null last), then the smallest URL, then ``more``."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url", *more))


def originals(heads: DataFrame, least_bytes: int = 0, salt_rows: int = SALT_ROWS) -> tuple[DataFrame, int]:
    """The original of every repeated payload of at least ``least_bytes`` bytes, once for each sub-key of its digest, and the number of sub-keys."""
    salts = max(1, -(-heads.count() // salt_rows))
    part = materialise(
        heads.where(F.col("size") >= least_bytes).groupBy(*_KEY, _salt(salts)).agg(_first("number").alias("first"), F.count("*").alias("n")), "warc-digests"
    )
    whole = part.groupBy(*_KEY).agg(F.min("first").alias("original"), F.sum("n").alias("n")).where("n > 1").drop("n")
    return part.select(*_KEY, "salt").join(whole, _KEY), salts


def _salt(salts: int):
    return F.pmod(F.xxhash64("number"), F.lit(salts)).alias("salt")


def _word(words: int):
    return F.pmod(F.shiftright(F.xxhash64("digest", "size"), 6), F.lit(words)).alias("word")


def _bit():
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64("digest", "size").bitwiseAND(F.lit(63)).cast("int"))


def _may_repeat(rows: DataFrame, repeated: DataFrame, words: int) -> DataFrame:
    """Add ``repeats``: false only where no digest of ``repeated`` equals the row's."""
    bits = repeated.groupBy(_word(words)).agg(F.bit_or(_bit()).alias("bits"))
    marked = rows.withColumn("word", _word(words)).join(F.broadcast(bits), "word", "left")
    return marked.withColumn("repeats", F.coalesce(F.col("bits").bitwiseAND(_bit()) != 0, F.lit(False))).drop("word", "bits")


def resolve(heads: DataFrame, repeated: DataFrame, salts: int, words: int = _WORDS) -> DataFrame:
    """The headers that are revisits, with ``refers_to``, the id of the original."""
    met = _may_repeat(heads, repeated, words).where("repeats").withColumn("salt", _salt(salts)).join(repeated, [*_KEY, "salt"])
    return met.where(F.col("number") != F.col("original.number")).select("id", "url", "digest", "size", "number", F.col("original.id").alias("refers_to"))


def _uuid(*parts):
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value):
    """A header line; a null value leaves the line out, line breaks become spaces."""
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit(CRLF))).otherwise("")


def _record(revisit: bool, date: str):
    """A record as one string; ``name`` tells records of one page and payload apart."""
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    other = F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))
    return F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.lit("revisit" if revisit else "response")),
        _line("WARC-Record-ID", _uuid(key, F.col("digest"), F.col("name"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Page-Id", F.col("id").cast("string")),
        _line("WARC-Payload-Length", F.col("size").cast("string")),
        *([_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _uuid(other, F.col("digest"), F.lit(""))), _line("WARC-Refers-To-Page-Id", F.col("refers_to").cast("string"))] if revisit else []),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.lit("0") if revisit else F.col("size").cast("string")),
        F.lit(CRLF),
        *([] if revisit else [F.col("p").cast("string")]),
    )


def _filed(file_bytes: int):
    """Number the files of a task: a new one begins once ``file_bytes`` are passed."""

    def run(batches):
        before = 0
        for batch in batches:
            ends = before + np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
            if len(ends):
                before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((ends // file_bytes).astype(np.int32))], names=["value", "file"])

    return run


def write(
    pages: DataFrame, path: str, date: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES, words: int = _WORDS
) -> None:
    """Write one fresh record per row below ``path``.

    Responses carry their payload; revisits have an empty block and name the
    original record.  The payload's size and digest are in every header, so a
    reader of a revisit knows what it stands for.  Every record has an id of its
    own: of rows that repeat the smallest id of a payload, one is the response.
    """
    heads = materialise(headers(pages, id_col, url_col, payload_col), "warc-headers")
    found, salts = originals(heads, least_bytes)
    found = materialise(found, "warc-originals")
    repeated = found.select(*_KEY).distinct()
    none = F.lit(None).cast("long").alias("refers_to")
    rows = _may_repeat(_digested(pages, id_col, url_col, payload_col), repeated, words)
    again = F.col("repeats") & (F.col("size") >= least_bytes)
    # payloads below least_bytes may repeat as responses; nothing refers to them, so any name will do
    name = F.when(F.col("size") < least_bytes, F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string"))).otherwise("")
    alone = rows.where(~again).withColumn("name", name).select("id", "url", "digest", "size", "name", none, "p")
    grouped = rows.where(again).groupBy(*_KEY).agg(_first().alias("f"), F.first("p").alias("p"))
    kept = grouped.select("f.id", "f.url", "digest", "size", F.lit("").alias("name"), none, "p")
    later = resolve(heads, found, salts, words).withColumn("name", F.concat(F.lit("v"), F.col("number").cast("string")))
    records = alone.unionByName(kept).select(_record(False, date).alias("value")).unionByName(later.select(_record(True, date).alias("value")))
    numbered = records.mapInArrow(_filed(file_bytes), "value string, file int")
    numbered.write.partitionBy("file").option("lineSep", END).option("compression", "gzip").text(path)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def records(pieces):
    """(headers, block) of each record of an archive, given as its bytes or an iterable of pieces of them.

    Blocks are cut by their Content-Length, so a payload may hold anything,
    record marks included.  No more than a record and a piece are held.  Broken
    archives raise ``ValueError``.
    """
    pieces = iter([pieces] if isinstance(pieces, bytes) else pieces)
    mark, close = (VERSION + CRLF).encode(), END.encode()
    held, at = bytearray(), 0

    def more(size: int) -> bool:
        """Whether ``size`` bytes from ``at`` on are held, after reading on if need be."""
        nonlocal held, at
        if at > 1 << 20 or (at and len(held) - at < size):
            del held[:at]
            at = 0
        while len(held) - at < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held += piece
        return True

    while more(1):
        if not more(len(mark)) or not held.startswith(mark, at):
            raise ValueError("no record where one should begin")
        stop, look = -1, len(mark)
        while (stop := held.find(close, at + look)) < 0:
            look = max(len(mark), len(held) - at - len(close))
            if not more(len(held) - at + 1):
                raise ValueError("a header has no end")
        head = bytes(held[at + len(mark) : stop + 2])
        fields = {m[1].decode().lower(): m[2].decode() for m in _HEADER.finditer(head)}
        at = stop + 4
        size = int(fields["content-length"])
        if not more(size + 4) or held[at + size : at + size + 4] != close:
            raise ValueError("a block does not end where its header says")
        yield fields, bytes(held[at : at + size])
        at += size + 4


def _inflate(raw: bytes, piece: int = 1 << 20):
    """The content of a gzip file of any number of members, in pieces; other bytes as they are."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(raw) or member.eof:
        if member.eof:
            if at >= len(raw):
                return
            member = zlib.decompressobj(31)
        part = raw[at : at + (1 << 18)]
        at += len(part)
        while part and not member.eof:
            if out := member.decompress(part, piece):
                yield out
            part = member.unconsumed_tail
        at -= len(member.unused_data)
    while out := member.decompress(member.unconsumed_tail, piece):
        yield out
    if not member.eof:
        raise ValueError("a gzip member has no end")


READ = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, refers_to_record string, payload binary, intact boolean"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record below ``path``.

    ``intact`` tells whether a response's block has the size and digest that its
    header names (true for revisits, which have no block).
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for fields, block in records(_inflate(content.as_py())):
                    kind = fields["warc-type"]
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    n = int(fields["warc-payload-length"])
                    intact = kind == "revisit" or (n == len(block) and base64.b32encode(hashlib.sha1(block).digest()).decode() == digest)
                    own, other = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
                    rows.append(
                        (fields["warc-record-id"], kind, own and int(own), fields.get("warc-target-uri"), digest, n, other and int(other), fields.get("warc-refers-to"), None if kind == "revisit" else block, intact)
                    )
                    size += len(block)
                    if size > 4_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, READ)


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)


def archive(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", **options) -> DataFrame:
    """Write ``pages`` to a new archive in shared storage and return what a reader finds there."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, date, **options)
    return read(pages.sparkSession, path)

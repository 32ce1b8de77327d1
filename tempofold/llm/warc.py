"""WARC archives: records out, monolithic gzip in, one member per record and a sidecar index out.

Archives go through Spark's text source and sink, so they may lie in any store Spark can reach, writes
commit by task, and a lost executor repeats only its files.

- Records are divided by two line breaks, which the text sink writes as its separator; its gzip codec
  makes one stream of a whole file, as monolithic archives are.
- The text source inflates such a stream from front to back, once, and hands out pieces between record
  starts; a record whose payload holds such a start is put together again by its Content-Length.
- A gzip member ends with the top byte of its length, zero below 16 MiB. The sink's separator is that
  byte, so rows without their last byte come out as plain gzip members, one after another.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BREAK, START = "\r\n\r\n", "WARC/1.1\r\n"
#: Records of one monolithic archive at most: bounds its size, for one task inflates a whole archive.
RECORDS_PER_FILE = 20_000
#: Revisits that may be broadcast to the scan of the pages.
BROADCAST_ROWS = 200_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MEMBERS = "archive string, seq long, member binary"
INDEX = "archive string, seq long, offset long, length long, record_type string, record_id string"
RECORDS = "record_type string, record_id string, target string, date string, refers_to string, digest string, payload_bytes long, payload binary, checked boolean"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: four letters from each five hexadecimal digits."""
    h = F.sha1(payload)
    parts = []
    for g in range(8):
        n = F.conv(F.substring(h, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def revisits(pages: DataFrame, least: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """page_id, digest, keep: the records that revisit another one of equal payload, of at least ``least`` bytes. The largest page_id is the response."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keys = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes")).where(F.col("page_id").isNotNull() & (F.col("bytes") >= least))
    # One row per digest and task leaves for the shuffle; the join back carries ids and digests only.
    keep = keys.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keep")
    return keys.join(keep, "digest").where("page_id <> keep").select("page_id", "digest", "keep").distinct()


def record(pages: DataFrame, least: int = 0, date: str = "2020-01-01T00:00:00Z", id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One text row per row of ``pages``: a whole WARC record without its closing breaks.

    Null payloads are empty, null urls an empty target. A row without an id is a response of its own.
    Rows that repeat an id are records of their own; where they also repeat the payload, each is what
    a single one would be. Extra columns are not read.
    """
    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7F]+", "%20").alias("target"))
    # Where few records revisit others their keys go to the scan; else the records are shuffled to them.
    again = common.written(revisits(pages, least, id_col, payload_col), "warc-revisits")
    again = F.broadcast(again) if again.count() <= broadcast_rows else again
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).join(again, ["page_id", "digest"], "left")
    again = F.col("keep").isNotNull()
    head = F.concat(
        F.lit(START), F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), F.coalesce(uri(F.col("page_id")), F.lit("<urn:page:>")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("target"), F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload").cast("binary")),
        F.lit("\r\nX-Payload-Length: "), F.octet_length("payload").cast("string"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), uri(F.col("keep")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(again, "0").otherwise(F.octet_length("payload").cast("string")), F.lit(BREAK))
    return rows.select(F.concat(head, F.when(again, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write_monolithic(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Whole-file gzip streams of records."""
    records.write.option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, piece: what lies between record starts, in order within a file. A gzip file is never split."""
    raw = spark.read.option("lineSep", BREAK + START).text(path)
    return raw.select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("piece"))


def whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(file, record up to its closing breaks). Pieces are joined until the Content-Length is met."""
    file, held, need, glue = None, b"", 0, (BREAK + START).encode()
    for batch in batches:
        for name, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist()):
            if name != file:
                if held:
                    raise ValueError(f"{file}: a record ends before its Content-Length")
                file, first = name, True
            if held:
                held += glue + piece
            else:
                held = piece if first and piece.startswith(START.encode()) else START.encode() + piece
            first = False
            if not need and (end := held.find(BREAK.encode())) >= 0:  # a payload may itself begin like a record
                need = end + 4 + int(fields(held[:end])["content-length"])
            if need and len(held) >= need:
                if held[need:] not in (b"", BREAK.encode()):
                    raise ValueError(f"{file}: a record goes on after its Content-Length")
                yield file, held[:need]
                held, need = b"", 0
    if held:
        raise ValueError(f"{file}: a record ends before its Content-Length")


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def members(mono: DataFrame) -> DataFrame:
    """Each record as a gzip member without its last byte, in the order of its archive."""
    return mono.mapInArrow(_members, MEMBERS)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.binary())
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["archive", "seq", "member"])
    rows, size, file, seq = [], 0, None, 0
    for name, data in whole_records(batches):
        if name != file:
            file, seq = name, 0
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(data + BREAK.encode()) + pack.flush()
        if member[-1]:  # 16 MiB or more: an empty member brings the zero that the sink's separator stands for
            member += zlib.compressobj(6, zlib.DEFLATED, 31).flush()
        rows.append((name, seq, member[:-1]))
        seq, size = seq + 1, size + len(member)
        if size > 4_000_000:
            yield make(rows)
            rows, size = [], 0
    if rows:
        yield make(rows)


def normalise(spark: SparkSession, source: str, out: str) -> None:
    """Monolithic archives under ``source`` -> ``out``/archives/archive=<name>/ and ``out``/index (a table: archive, seq, offset, length, type, id).

    One task inflates a whole archive and writes it again, so nothing is shuffled; the index is taken
    from what was written.
    """
    ordered = members(pieces(spark, source)).sortWithinPartitions("archive", "seq")
    ordered.select("archive", F.col("member").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", "\0").text(f"{out}/archives")
    archives(spark, out).select(F.regexp_extract("path", r"/archive=([^/]+)/", 1).alias("archive"), "content").mapInArrow(_index, INDEX).write.parquet(f"{out}/index")


def archives(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{out}/archives")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        for name, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
            rows = []
            for start, end, data in split_members(content.as_py()):
                if data:
                    head = fields(data[: data.index(BREAK.encode())])
                    rows.append((name, len(rows), start, end - start, head.get("warc-type"), head.get("warc-record-id")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in INDEX.split(", ")])


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """Every record of the normalised archives, parsed; ``checked`` where the digest of the payload was recomputed and met."""
    return archives(spark, out).select("content").mapInArrow(_records, RECORDS)


def split_members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and inflated bytes of each member of an archive."""
    view, at = memoryview(data), 0
    while at < len(view):
        pull, parts, start = zlib.decompressobj(31), [], at
        while not pull.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a member")
            chunk = view[at : at + 65536]
            parts.append(pull.decompress(chunk))
            at += len(chunk) - len(pull.unused_data)
        yield start, at, b"".join(parts)


def parse(record: bytes) -> tuple:
    end = record.index(BREAK.encode())
    head = fields(record[:end])
    payload = record[end + 4 : end + 4 + int(head["content-length"])]
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    own = head.get("warc-type") == "response"
    return (head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-refers-to"), digest, int(head.get("x-payload-length", len(payload))),
            payload, own and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.bool_()]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for _, _, data in split_members(content.as_py()):
                if data:
                    rows.append(parse(data))
                    size += len(data)
                if size > 8_000_000:
                    yield make(rows)
                    rows, size = [], 0
            if rows:
                yield make(rows)




def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    mono, out = common.scratch(spark, "warc-monolithic"), common.scratch(spark, "warc-normal")
    write_monolithic(record(common.table(spark, sf_dir, "pages")), mono)
    normalise(spark, mono, out)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
    back = read_records(spark, out)
    # A response stands for its payload only if the payload read back has the digest it was written with.
    sound = F.when((F.col("record_type") == "revisit") | F.col("checked"), F.col("digest"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return back.select(page("record_id").alias("page_id"), size.alias("payload_bytes"), sound.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


_LETTERS = " || ".join(f"substr('{BASE32}', ((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
s AS (SELECT page_id, body, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS keep FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM s
"""

QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": ORACLE}

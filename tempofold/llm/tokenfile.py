"""Token ids in Parquet: list columns in document order, with an index of shards.

A token file is a folder of two tables.

``shards``  one Parquet file per range of documents, in order: ``shard``, ``at`` (ids before the document
            in its shard), ``doc_id``, ``n_tokens``, ``ids`` (list of int). Row groups and pages have set
            sizes, pages are indexed; the ascending columns are delta coded, ids by dictionary (whole
            corpus vocabularies fit one) or by deltas.
``index``   one row per shard: ``shard``, ``rows``, ``tokens``, ``start`` (ids in all shards before it).

Metadata reads leave the id column alone; reads by document or by place in the stream of all ids push
their bounds to row groups and pages.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END_ID = 2
#: Bytes of input files per shard; a smaller corpus is still cut so that every core has one, down to MIN_SHARD bytes.
SHARD_BYTES, MIN_SHARD = 32 << 20, 2 << 20
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 1_000
ENCODINGS = ("dictionary", "delta")
ROWS = "shard int, at long, doc_id long, n_tokens long, ids array<int>"
INDEX = "shard int, rows long, tokens long, start long"
CHECKED = "doc_id long, shard int, at long, n_tokens long, ids_crc32 long"
#: Words that an encoder remembers before it starts anew; bytes of text it takes at a time.
WORDS_HELD, BLOCK_BYTES = 1_000_000, 1_000_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A stretch between white space that the library encodes as it stands: it has a character other than ASCII and
#: the letters from U+00C0 to U+00FF (whose normal form is their lower case), or may hold an added token.
ODD = re.compile(rb"[\xc2\xc4-\xff]|\xc3[\x97\xb7]|<\|")
RARE, ODD_BYTES = (b"<|", b"\xc3\x97", b"\xc3\xb7"), np.isin(np.arange(256), [0xC2, *range(0xC4, 0x100)])
BREAK = re.compile(rb"[\t-\r ]")
SPACE, LETTER, DIGIT, MARK = range(4)
#: What each byte belongs to; bytes from 0x80 on are left to letters once odd stretches are set aside.
CLASSES = np.array([SPACE if b in b" \t\n\v\f\r" else LETTER if 97 <= b <= 122 or b >= 128 else DIGIT if 48 <= b <= 57 else MARK for b in range(256)], np.uint8)
#: After an apostrophe that no other mark precedes, these letters are one word with it.
SHORT = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


def spelling() -> dict[int, int]:
    """Bytes as characters of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


class Encoder:
    """UTF-8 text -> ids, as the library gives them for the whole text without special tokens.

    The tokenizer drops white space and no token, added token, composition or lower-casing reaches over
    an ASCII white space character. Between those, plain text falls into words of letters, single digits
    and runs of marks, each a word of the library's model. Words are found and told apart (by 64-bit
    hashes) as arrays, and the library encodes each distinct one once; odd stretches it encodes whole.
    Only vocabularies that drop white space may be used (checked when one is loaded).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self._whole(b"a b") != [*self._whole(b"a"), *self._whole(b"b")] or self._whole(b" \t\n\v\f\r"):
            raise ValueError(f"{path}: white space is part of tokens")
        self.spelling, self.model = spelling(), self.library.model
        self._forget()

    def _whole(self, piece: bytes) -> list[int]:
        return self.library.encode(piece.decode(), add_special_tokens=False).ids

    def _forget(self) -> None:
        # Hashes ascend; word k has size[k] ids from first[k] on.
        self.hashes, self.first, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _word(self, word: bytes) -> list[int]:
        if ODD.search(word):
            return self._whole(word)
        spelt = word.decode("latin1") if word.isalpha() else word.decode().lower().encode().decode("latin1").translate(self.spelling)
        return [t.id for t in self.model.tokenize(spelt)]

    def _encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids per word, first byte of each word)."""
        data = np.frombuffer(bytearray(text.lower()), np.uint8)
        kind = CLASSES[data]
        if any(x in text for x in RARE) or ODD_BYTES[data].any():
            odd = np.fromiter((m.start() for m in ODD.finditer(text)), np.int64)
            gaps = np.concatenate(([-1], np.flatnonzero(kind == SPACE), [len(kind)]))
            for k in np.unique(np.searchsorted(gaps, odd)).tolist():
                a, b = gaps[k - 1] + 1, gaps[k]
                data[a:b], kind[a:b] = np.frombuffer(text[a:b], np.uint8), LETTER
        edge = np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == DIGIT)
        quotes = np.flatnonzero((data[:-1] == 39) & edge[:-1] & (kind[:-1] == MARK) & (kind[1:] == LETTER))
        for p in quotes.tolist():
            tail = bytes(data[p + 1 : p + 3])
            n = next((len(x) for x in SHORT if tail.startswith(x)), 0)
            if n:
                edge[p + 1] = False
                edge[p + 1 + n : p + 2 + n] |= kind[p + 1 + n : p + 2 + n] == LETTER
        cuts = np.append(np.flatnonzero(edge), len(kind))
        word = kind[cuts[:-1]] != SPACE
        start, end = cuts[:-1][word], cuts[1:][word]
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), start
        hashes, one, each = np.unique(common.ByteHash(data).of(start, end), return_index=True, return_inverse=True)
        known = np.isin(hashes, self.hashes, assume_unique=True)
        if not known.all():
            self._learn(hashes[~known], [bytes(data[start[k] : end[k]]) for k in one[~known]])
        at = np.searchsorted(self.hashes, hashes)[each]
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.first[at] - (ends - size), size) + np.arange(ends[-1])], size, start

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        lists = [self._word(w) for w in words]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        first = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(size.sum()))])
        hashes, first, size = (np.concatenate(x) for x in ((self.hashes, hashes), (self.first, first), (self.size, size)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.first, self.size = hashes[order], first[order], size[order]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        body, at, parts = b"\n".join(texts), 0, []
        while at < len(body):
            # Long texts are taken in stretches that end at white space.
            gap = BREAK.search(body, at + BLOCK_BYTES)
            end = gap.start() if gap else len(body)
            ids, size, start = self._encode(body[at:end])
            parts.append((ids, size, start + at))
            at = end
            if len(self.hashes) > WORDS_HELD:
                self._forget()
        ids, size, start = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        # Words before each text, then ids before it.
        edges = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        return ids, np.diff(np.concatenate(([0], np.cumsum(size)))[edges])


def write(docs: DataFrame, path: str, encoding: str = "dictionary", shard_bytes: int = SHARD_BYTES, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
          page_rows: int = PAGE_ROWS, end_id: int = END_ID, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the token file of ``docs`` to a new folder that all executors share; returns its path.

    Null and empty texts are the end id alone. Documents ascend by id, null ids first; rows with equal
    ids stay rows of their own, in the order of their input. No rows in: a file without rows. Extra
    columns are not read, so their names may clash. Texts of any length are encoded whole; one
    document's ids must fit a list of 2**31 bytes.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    spark = docs.sparkSession
    docs = common.backed(docs.select(F.col(id_col), F.col(text_col)))  # other columns are not read
    # Texts go to their range once and are encoded there, so ids are written once and never shuffled.
    rows = common.located(docs, id_col, text_col).select("doc_id", F.xxhash64("file").alias("place"), "row", F.col("text").cast("binary").alias("text"))
    file, size = common.metadata(docs, "file_path", "file_size")
    held = docs.select(file.alias("file"), size.alias("size")).distinct().agg(F.sum("size")).first()[0] or 0
    ranges = max(-(-held // shard_bytes), min(spark.sparkContext.defaultParallelism, held // MIN_SHARD), 1)
    order = [F.col("doc_id").asc_nulls_first(), F.col("place"), F.col("row")]
    # The tie columns decide the order only and stay on this side.
    sent = rows.repartitionByRange(int(ranges), *order).sortWithinPartitions(*order).select("doc_id", "text")
    ids = sent.mapInArrow(functools.partial(_encoded, end_id=end_id, path=vocabulary_path or vocabulary()), ROWS)
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size.row.check.min": "10",  # long documents fill a page or row group in a few rows
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        # Without a dictionary, integers of this version are delta coded.
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("at", "doc_id", "n_tokens")},
        "parquet.enable.dictionary#ids.list.element": "true" if encoding == "dictionary" else "false",
    }
    ids.write.options(**options).parquet(f"{path}/shards")
    # One row per shard: the window is over shards, not documents.
    tally = metadata(spark, path).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"))
    tally.select("shard", "rows", "tokens", F.expr("sum(tokens) over (order by shard) - tokens").alias("start")).coalesce(1).write.parquet(f"{path}/index")
    return path


def _encoded(batches: Iterator[pa.RecordBatch], end_id: int, path: str) -> Iterator[pa.RecordBatch]:
    shard, before, encoder = TaskContext.get().partitionId(), 0, None
    for batch in common.blocks_of_bytes(batches, "text", BLOCK_BYTES):
        encoder = encoder or Encoder(path)
        ids, size = encoder(batch.column("text").to_pylist())
        ids, ends = np.insert(ids, np.cumsum(size), end_id), np.cumsum(size + 1)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), shard, np.int32)), pa.array(before + ends - size - 1), batch.column("doc_id"), pa.array(size + 1), lists],
                                         ["shard", "at", "doc_id", "n_tokens", "ids"])
        before += int(ends[-1])


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{path}/shards")


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """shard, at, doc_id, n_tokens: the id column is not read."""
    return shards(spark, path).drop("ids")


def documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows of the documents with ids from ``first`` to ``last``; the bounds reach row groups and pages."""
    return shards(spark, path).where(F.col("doc_id").between(first, last))


def window(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """doc_id, start, ids: the stretch of ids from place ``first`` to before ``last`` of all ids, document by document.

    Shards come from the index (a handful of rows, since they follow one another), documents from their place in them.
    """
    touched = index(spark, path).where((F.col("start") < last) & (F.col("start") + F.col("tokens") > first)).orderBy("shard").collect() if last > first else []
    rows = shards(spark, path)
    if not touched:
        return rows.where("false").select("doc_id", F.col("at").alias("start"), "ids")
    # Whole shards lie between the two outer ones, so two bounds on (shard, at) say it all.
    low, high = touched[0], touched[-1]
    kept = rows.where(F.col("shard").between(low.shard, high.shard))
    kept = kept.where((F.col("shard") > low.shard) | (F.col("at") + F.col("n_tokens") > first - low.start))
    kept = kept.where((F.col("shard") < high.shard) | (F.col("at") < last - high.start))
    placed = kept.join(index(spark, path).select("shard", F.col("start").alias("base")), "shard").withColumn("start", F.col("base") + F.col("at"))
    skip = F.greatest(F.lit(0), F.lit(first) - F.col("start")).cast("int")
    until = F.least(F.col("n_tokens"), F.lit(last) - F.col("start")).cast("int")
    return placed.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", skip + 1, until - skip).alias("ids"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the ids in the files."""
    rows = shards(spark, path).select("doc_id", "shard", "at", "ids").mapInArrow(_checked, CHECKED)
    placed = rows.join(index(spark, path).select("shard", F.col("start").alias("base")), "shard")
    return placed.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        edges = np.asarray(lists.offsets)
        raw = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges.tolist(), edges[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("at"), pa.array(np.diff(edges), pa.int64()), pa.array(crc, pa.int64())],
                                         ["doc_id", "shard", "at", "n_tokens", "ids_crc32"])


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, from the token file written of all of them."""
    return checksums(spark, write(common.table(spark, sf_dir, "documents"), common.scratch(spark, "token-file")))


QUERIES = {"op11_token_ids": op11_token_ids}
ORACLES: dict[str, str] = {}

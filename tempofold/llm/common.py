"""Helpers shared by the corpus operators: shared scratch tables, narrow inputs, byte-level words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What operators that speak of white space mean by it.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Only a local master, where driver and executors are one process, may go without the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = f"file://{tempfile.gettempdir()}/tempofold-scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read again, so that a lost executor costs one task, not the chain."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """The two columns an operator reads, under its own names; null text is the empty text."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(c.alias(k) for k, c in more.items()))


def metadata(df: DataFrame, *fields: str) -> list[Column]:
    """Fields of the files that rows come from, also where a column of the table is called as Spark calls them."""
    whole = df.metadataColumn("_metadata") if "_metadata" in df.columns else F.col("_metadata")
    return [whole.getField(f) for f in fields]


def _in_files(df: DataFrame) -> bool:
    try:
        df.select(*metadata(df, "file_path", "row_index")).schema  # resolves, or not
        return True
    except AnalysisException:
        return False


def backed(df: DataFrame) -> DataFrame:
    """A frame that reads files, so that its rows have a place (file and row) which every scan of it agrees on."""
    return df if _in_files(df) else written(df, "rows")


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, file, row."""
    if not _in_files(docs):
        docs, id_col, text_col = written(texts(docs, id_col, text_col), "texts"), "doc_id", "text"
    file, row = metadata(docs, "file_path", "row_index")
    return texts(docs, id_col, text_col, file=file, row=row)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a file-backed frame whose place is not among (file, row) of ``gone``."""
    mark = "__place"
    while mark in docs.columns or f"{mark}_gone" in docs.columns:
        mark += "_"
    file, row = metadata(docs, "file_path", "row_index")
    placed = docs.select("*", F.struct(file.alias("file_path"), row.alias("row_index")).alias(mark))
    keys = gone.select(F.struct(F.col("file").alias("file_path"), F.col("row").alias("row_index")).alias(f"{mark}_gone"))
    return placed.join(keys, F.col(mark) == F.col(f"{mark}_gone"), "left_anti").drop(mark)


def fold(doc_id: Column, of: int = 5) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Runs of equal keys as whole tables, from batches that come sorted by them."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [np.asarray(t[k].combine_chunks()) for k in keys]
        change = np.zeros(t.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


# Words of the text rules: A-Z lower-cased, runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F].
# One table maps every byte of UTF-8: bytes keep their places, so offsets need no second pass.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Odd multiplier of the byte polynomial, modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class ByteHash:
    """64-bit hashes of byte ranges of one buffer: prefix sums of a polynomial, so any range costs O(1)."""

    _up = _powers(_BASE, 1 << 16)
    _down = _powers(_INVERSE, 1 << 16)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(ByteHash._up) < n:
            ByteHash._up, ByteHash._down = _powers(_BASE, n + n // 4), _powers(_INVERSE, n + n // 4)
        self.sums = np.zeros(n, np.uint64)
        self.sums[1:] = data
        self.sums[1:] += np.uint64(1)
        self.sums[1:] *= ByteHash._up[: n - 1]
        np.cumsum(self.sums, out=self.sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * ByteHash._down[start])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def blocks_of_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text, one row at least, so that buffers stay small beside long rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + limit, "right")))
            yield batch.slice(a, b - a)
            a = b

"""Best-fit packing by minimum bin slack.

Only the counts of piece lengths decide what is packed: at most one count per length, however large
the corpus. Per bin, a subset-sum over the lengths still there (one integer as the set of reachable
sums) finds the fullest combination; the combination is then removed as often as the counts allow.
Pieces find their places from their rank among the pieces of their length.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, vocabulary

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``capacity``; longer lengths first among equals.

    Counts go in as powers of two, so each length costs a few shifts of one integer.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for size in sorted((s for s, n in counts.items() if n and s <= capacity), reverse=True):
        left, k = min(counts[size], capacity // size), 1
        while left:
            k = min(k, left)
            steps.append((size, k, reach))
            reach |= reach << (size * k) & mask
            left, k = left - k, 2 * k
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for size, k, before in reversed(steps):
        if not before >> total & 1:
            chosen[size] = chosen.get(size, 0) + k
            total -= size * k
    return chosen


def bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how often, lengths of the bin): every bin starts with the longest piece left and is filled as far as can be."""
    left, out = {s: n for s, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[s] // n for s, n in chosen.items())
        for s, n in chosen.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        out.append((times, sorted((s for s, n in chosen.items() for _ in range(n)), reverse=True)))
    return out


def places(packed: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset), ascending by rank: rank r of a range lies in sequence first + r - first rank."""
    out, taken, sequence = {}, {}, 0
    for times, sizes in packed:
        at = 0
        for s in sizes:
            rank = taken.get(s, 0)
            out.setdefault(s, []).append((rank, sequence, at))
            taken[s], at = rank + times, at + s
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def cut(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """Pieces of every row: its ids and the end id; only longer rows are cut, the remainder first."""
    return common.texts(docs, id_col, text_col).mapInArrow(functools.partial(_cut, capacity=capacity, end_id=end_id, paths=paths or vocabulary()), PIECES)


def _cut(batches: Iterator[pa.RecordBatch], capacity: int, end_id: int, paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    encode, part, seen = encoder(paths), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    names = [c.split()[0] for c in PIECES.split(", ")]
    for batch in common.blocks_of_bytes(batches, "text", 8_000_000):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
            head = len(ids) % capacity
            edges = [0, *range(head or capacity, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(seen[b - a])))
                seen[b - a] += 1
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, cols)], names)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, **columns) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Rows with equal or null ids are packed each on its own.
    No rows in, none out. Extra columns are not read.
    """
    spark = docs.sparkSession
    pieces = common.written(cut(docs, capacity, end_id, **columns), "packing-pieces")  # encoded once
    tally = common.written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "packing-tally")
    # One count per length, at most ``capacity`` rows: the only thing that the driver sees.
    counts = {r[0]: r[1] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(bins(counts, capacity)))
    # Rank among all pieces of a length: the task's own count plus what earlier tasks hold of that length.
    before = tally.select("part", "length", (F.expr("sum(n) over (partition by length order by part)") - F.col("n")).alias("before"))
    return pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank")).mapInArrow(_placed(shared), PLACED)


def _placed(shared):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            sizes, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.zeros_like(sizes), np.zeros_like(sizes)
            for s in np.unique(sizes):
                rows, mine = table[int(s)], np.flatnonzero(sizes == s)
                at = np.searchsorted(rows[:, 0], rank[mine], "right") - 1
                sequence[mine], offset[mine] = rows[at, 1] + rank[mine] - rows[at, 0], rows[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}

"""Hard negatives by an inverted multi-index over inner products.

Vectors are cut into halves, each half-space gets a codebook, and a row lies in the cell of its two
nearest centroids. For a query, a centroid bounds the half score of its members by its own half score
plus the query's norm times the cluster's radius; a multi-sequence heap visits cells by the sum of the
two bounds, highest first. What is asked of a query is the first k rows of a window of scores, and it is
certified once the k-th found beats the next cell's bound, or that bound falls below the window. The
answer is therefore exact, however well or badly the codebooks fit; they only save visits.

Cells are stored in chunks of bounded size, whatever their number of rows. A round plans the next cells
of every open query, sends the query to their chunks, scores blocks of queries against chunks, and
keeps k rows per query; rounds grow eightfold, so there are few.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows the codebooks are fitted to, and their largest size: the directory has at most its square in rows.
SAMPLE, LARGEST_BOOK = 20_000, 256
#: Rows of a cell aimed at, rows of a chunk, queries of a block, rows a query visits in its first round and growth of later ones.
CELL_ROWS, CHUNK_ROWS, BLOCK, FIRST_ROWS, GROWTH = 1_024, 2_048, 1_024, 16_384, 8
LOWEST, HIGHEST = -(2**63) + 1, 2**63 - 1
CHUNKS = "cell int, chunk int, ids binary, labels binary, vecs binary"
ASKS = "q long, vec_id long, label long, same boolean, lo long, hi long, vec binary"
FOUND = "q long, neg long, id long"
BEST = "array<struct<neg:long,id:long>>"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def rows_of(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """pos, vec_id, label, v: the rows that take part, components as whole numbers floor(256 x); ``pos`` tells rows apart."""
    usable = F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    labelled = table.select(F.col(id_col).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vector_col).alias("v"), usable.alias("usable"))
    kept = labelled.where(F.col("usable") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    return kept.select(F.monotonically_increasing_id().alias("pos"), "vec_id", "label", F.transform("v", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double")).alias("v"))


def codebook(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds; an emptied one keeps its place."""
    distinct = np.unique(points, axis=0) if points.shape[1] else points[:1]
    centres = distinct[np.random.default_rng(7).permutation(len(distinct))[:size]]
    for _ in range(rounds):
        near = nearest(points, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


class Index:
    """Codebooks, radii and chunked cells over the rows of ``rows_of``; ``rows`` are the rows with their cell."""

    def __init__(self, points: DataFrame, cell_rows: int = CELL_ROWS, chunk_rows: int = CHUNK_ROWS, sample: int = SAMPLE):
        points = common.written(points, "negatives-rows")
        sizes = points.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most"))
        # The commonest length counts, the longer one on a tie; a vector of another length has no product with it.
        common_size = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
        self.empty = common_size is None
        if self.empty:
            return
        self.dim, n = common_size.dim, common_size.n
        most = self.dim * (common_size.most or 0.0) ** 2
        if most >= 2.0**62:
            raise ValueError("inner products of these vectors do not fit a long")
        self.kind = "<f4" if most < 2**24 else "<f8" if most * chunk_rows < 2**53 else "<i8"
        points = points.where(F.size("v") == self.dim)
        # A bounded sample, spread by hash: only the codebooks come from it.
        drawn = points.orderBy(F.xxhash64("pos")).limit(sample).select("v").collect()
        drawn = np.array([r.v for r in drawn], float).reshape(len(drawn), self.dim)
        books = [codebook(half, int(min(LARGEST_BOOK, max(1, (n / cell_rows) ** 0.5)))) for half in np.split(drawn, [self.dim // 2], axis=1)]
        self.rows = common.written(points.mapInArrow(functools.partial(_celled, books=books, kind=self.kind), "pos long, vec_id long, label long, vec binary, cell int, r1 double, r2 double"), "negatives-cells")
        directory = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect()  # at most a row per pair of centroids
        shape = tuple(map(len, books))
        self.counts, radii = np.zeros(shape, np.int64), [np.zeros(k) for k in shape]
        for r in directory:
            i, j = divmod(r.cell, shape[1])
            self.counts[i, j] = r.n
            radii[0][i], radii[1][j] = max(radii[0][i], r.r1), max(radii[1][j], r.r2)
        self.books, self.radii = books, radii
        spark = points.sparkSession
        self.directory = spark.createDataFrame([(r.cell, -(-r.n // chunk_rows)) for r in directory], "cell int, chunks long")
        placed = self.rows.join(F.broadcast(self.directory), "cell").select("cell", (F.col("pos") % F.col("chunks")).cast("int").alias("chunk"), "vec_id", "label", "vec")
        placed = placed.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "vec_id")
        self.chunks = common.written(placed.mapInArrow(_packed, CHUNKS), "negatives-chunks")

    def first(self, queries: DataFrame, k: int) -> DataFrame:
        """q, best: for each query (columns of ASKS, ``q`` unique) the first ``k`` rows with lo <= score <= hi, labels the same or different, never its own id.

        ``best`` is an array of (neg, id), neg the score's negative, in order: higher scores first, ties by id.
        """
        state = common.written(queries.select("q", "vec_id", "label", "same", "lo", "hi", "vec", F.lit(0).alias("taken"), F.array().cast(BEST).alias("best")), "negatives-queries")
        open_rows, done, budget = state, [], FIRST_ROWS
        while True:
            plan = functools.partial(_planned, books=self.books, radii=self.radii, counts=self.counts, kind=self.kind, budget=budget, k=k)
            planned = common.written(open_rows.mapInArrow(plan, f"{ASKS}, taken int, best {BEST}, cells array<int>"), "negatives-plan")
            done.append(planned.where(F.size("cells") == 0).select("q", "best"))
            going = planned.where(F.size("cells") > 0)
            n = going.count()
            if not n:
                return functools.reduce(DataFrame.unionAll, done)
            asked = going.select(F.explode("cells").alias("cell"), F.struct(*(c.split()[0] for c in ASKS.split(", "))).alias("ask")).join(F.broadcast(self.directory), "cell")
            asked = asked.select("cell", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("chunk"), F.pmod(F.xxhash64("ask.q"), F.lit(-(-n // BLOCK))).alias("part"), "ask")
            # Blocks of about BLOCK queries at a chunk; grouping and join keep the partitioning of the first line.
            blocks = asked.repartition("cell", "chunk").groupBy("cell", "chunk", "part").agg(F.collect_list("ask").alias("asks"))
            found = blocks.join(self.chunks, ["cell", "chunk"]).select("asks", "ids", "labels", "vecs").mapInArrow(functools.partial(_scored, dim=self.dim, kind=self.kind, k=k), FOUND)
            news = found.groupBy("q").agg(F.collect_list(F.struct("neg", "id")).alias("more"))
            both = F.sort_array(F.concat("best", F.coalesce("more", F.array().cast(BEST))))
            open_rows = common.written(going.join(news, "q", "left").select(*(c.split()[0] for c in ASKS.split(", ")), "taken", F.slice(both, 1, k).alias("best")), "negatives-state")
            budget *= GROWTH


def _matrix(vectors: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), kind).reshape(len(vectors), dim)


def _celled(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], kind: str) -> Iterator[pa.RecordBatch]:
    dim = books[0].shape[1] + books[1].shape[1]
    for batch in batches:
        if batch.num_rows:
            points = np.asarray(batch.column("v").flatten(), float).reshape(batch.num_rows, dim)
            halves = np.split(points, [books[0].shape[1]], axis=1)
            near = [nearest(h, b) for h, b in zip(halves, books)]
            radii = [np.sqrt(((h - b[i]) ** 2).sum(1)) for h, b, i in zip(halves, books, near)]
            vecs = pa.array([row.tobytes() for row in points.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("vec_id"), batch.column("label"), vecs, pa.array(near[0] * len(books[1]) + near[1], pa.int32()), *map(pa.array, radii)],
                                             ["pos", "vec_id", "label", "vec", "cell", "r1", "r2"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in common.grouped(batches, ["cell", "chunk"]):
        one = [t["cell"][0].as_py(), t["chunk"][0].as_py(), np.asarray(t["vec_id"]).astype("<i8").tobytes(), np.asarray(t["label"]).astype("<i8").tobytes(), b"".join(t["vec"].to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(one, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["cell", "chunk", "ids", "labels", "vecs"])


def visits(upper: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of all pairs, the sum of two bounds never rising: a heap over the two sorted sequences."""
    first, second = np.argsort(-upper[0], kind="stable"), np.argsort(-upper[1], kind="stable")
    a, b = upper[0][first].tolist(), upper[1][second].tolist()
    first, second = first.tolist(), second.tolist()
    reached = [0] * len(a)  # pairs of row x that have left the heap
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        bound, x, y = heapq.heappop(heap)
        yield -bound, first[x], second[y]
        reached[x] = y + 1
        if y + 1 < len(b) and (x == 0 or reached[x - 1] > y + 1):
            heapq.heappush(heap, (-(a[x] + b[y + 1]), x, y + 1))
        if x + 1 < len(a) and reached[x + 1] == y:
            heapq.heappush(heap, (-(a[x + 1] + b[y]), x + 1, y))


def _planned(batches: Iterator[pa.RecordBatch], books, radii, counts: np.ndarray, kind: str, budget: int, k: int) -> Iterator[pa.RecordBatch]:
    cut, dim, wide = books[0].shape[1], books[0].shape[1] + books[1].shape[1], counts.shape[1]
    for batch in batches:
        if not batch.num_rows:
            continue
        queries = np.split(_matrix(batch.column("vec"), dim, kind).astype(float), [cut], axis=1)
        mid = [q @ b.T for q, b in zip(queries, books)]
        reach = [np.sqrt((q**2).sum(1))[:, None] * r for q, r in zip(queries, radii)]
        # Whole scores within rounding of the bounds stay inside them.
        slack = 0.25 + 1e-9 * sum(np.abs(m).max(1) + r.max(1) for m, r in zip(mid, reach))
        lo, hi, taken, best = (batch.column(c).to_pylist() for c in ("lo", "hi", "taken", "best"))
        cells = []
        for q in range(batch.num_rows):
            upper, lower = [m[q] + r[q] for m, r in zip(mid, reach)], [m[q] - r[q] for m, r in zip(mid, reach)]
            last = -best[q][-1]["neg"] if len(best[q]) == k else None
            rows, mine, seen = 0, [], 0
            for bound, i, j in visits(upper):
                seen += 1
                if seen <= taken[q]:
                    continue
                bound += slack[q]
                # Rows of this score may still come, and tie with a smaller id.
                if rows >= budget or bound < lo[q] or (last is not None and last > bound):
                    seen -= 1
                    break
                if counts[i, j] and lower[0][i] + lower[1][j] - slack[q] <= hi[q]:
                    mine.append(i * wide + j)
                    rows += int(counts[i, j])
            cells.append(mine)
            taken[q] = seen
        names = [c.split()[0] for c in ASKS.split(", ")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(taken, pa.int32()), batch.column("best"), pa.array(cells, pa.list_(pa.int32()))], [*names, "taken", "best", "cells"])


def _first_of(q: np.ndarray, neg: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k entries of each query."""
    order = np.lexsort((ids, neg, q))
    q, neg, ids = q[order], neg[order], ids[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k
    return q[keep], neg[keep], ids[keep]


def _scored(batches: Iterator[pa.RecordBatch], dim: int, kind: str, k: int) -> Iterator[pa.RecordBatch]:
    held, n_held = [], 0

    def batch_of(parts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _first_of(*(np.concatenate(p) for p in zip(*parts)), k)], ["q", "neg", "id"])

    for batch in batches:
        for row in range(batch.num_rows):
            asks = batch.column("asks")[row].values
            ids, labels = (np.frombuffer(batch.column(c)[row].as_py(), "<i8") for c in ("ids", "labels"))
            chunk = np.frombuffer(batch.column("vecs")[row].as_py(), kind).reshape(len(ids), dim)
            q, own, label, same, lo, hi = (np.asarray(asks.field(c)) for c in ("q", "vec_id", "label", "same", "lo", "hi"))
            vectors = _matrix(asks.field("vec"), dim, kind)
            for a in range(0, len(q), 256):
                s = slice(a, a + 256)
                scores = (vectors[s] @ chunk.T).astype(np.int64)
                fits = ((labels == label[s, None]) == same[s, None]) & (ids != own[s, None]) & (scores >= lo[s, None]) & (scores <= hi[s, None])
                at = _leading(scores, fits, k, kind)
                held.append((q[s][at[0]], -scores[at], ids[at[1]]))
                n_held += len(at[0])
            if n_held > 1_000_000:
                held = [_first_of(*(np.concatenate(p) for p in zip(*held)), k)]
                n_held = len(held[0][0])
                if n_held > 500_000:
                    yield batch_of(held)
                    held, n_held = [], 0
    if held:
        yield batch_of(held)


def _leading(scores: np.ndarray, fits: np.ndarray, k: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the first k fitting entries of each row; columns ascend by id."""
    n = scores.shape[1]
    if kind == "<i8":  # too large to carry the column along
        picked = [np.flatnonzero(f)[np.lexsort((np.flatnonzero(f), -s[f]))[:k]] for s, f in zip(scores, fits)]
        return np.repeat(np.arange(len(picked)), list(map(len, picked))), np.concatenate([np.zeros(0, np.int64), *picked]).astype(np.int64)
    keys = np.where(fits, scores * n + np.arange(n - 1, -1, -1), LOWEST)
    if k < n:
        columns = np.argpartition(keys, n - k, axis=1)[:, n - k :]
    else:
        columns = np.broadcast_to(np.arange(n), keys.shape)
    rows = np.broadcast_to(np.arange(len(keys))[:, None], columns.shape)
    good = keys[rows, columns] != LOWEST
    return rows[good], columns[good]


def mine(index: Index, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """RESULT: for each anchor and each of its first positives, the first rows of another label that score low to high hundredths of the positive.

    ``anchors`` chooses them by vec_id. Higher scores come first, ties by smaller id. Rows without an id,
    a label or a usable vector take no part, nor do vectors of another length than the commonest. Rows
    with equal ids are rows each, but none is the anchor's positive or negative by its own id. No
    usable rows: no rows. Other columns are not read.
    """
    ask = index.rows.where(anchors).select(F.col("pos").alias("q"), "vec_id", "label", F.lit(True).alias("same"), F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi"), "vec")
    ask = common.written(ask, "negatives-anchors")
    near = index.first(ask, positives).select("q", F.posexplode("best").alias("nth", "p")).join(ask.select("q", "vec_id", "label", "vec"), "q")
    score = -F.col("p.neg")
    share = lambda part: score.cast("decimal(20,0)") * part / 100
    windows = near.select((F.col("q") * positives + F.col("nth")).alias("q"), "vec_id", "label", F.lit(False).alias("same"), F.ceil(share(low)).cast("long").alias("lo"), F.floor(share(high)).cast("long").alias("hi"),
                          "vec", F.col("p.id").alias("positive_id"), score.alias("positive_score"))
    windows = common.written(windows.where("lo <= hi"), "negatives-windows")
    found = index.first(windows, negatives).select("q", F.posexplode("best").alias("nth", "n"))
    out = found.join(windows.select("q", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score"), "q")
    return out.select("anchor_id", "positive_id", (F.col("nth") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.neg")).alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id 50 divides; where 7 divides vec_id the label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    index = Index(rows_of(common.table(spark, sf_dir, "embeddings"), label=label))
    return spark.createDataFrame([], RESULT) if index.empty else mine(index, F.col("vec_id") % 50 == 0)


_SQL = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM given a JOIN given b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op12_hard_negatives": _SQL}

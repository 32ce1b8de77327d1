"""N-gram Jaccard join by chosen paths.

Every text is a set of word shingles, every set a sketch of min-hash values; "token" below is one
value at one place of the sketch, and two sets of similarity s share a token with probability s. Each
run starts all sets in one bucket. A bucket is split by two tokens drawn for it, so a pair of
similarity s stays together somewhere with probability 1 - (1 - s)^2 a level, and with a bound above
zero at any depth. Splitting stops where a bucket is small, or where splitting would not lower the
number of pairs; the pairs of the buckets that are left are compared, large buckets in blocks. Runs
are repeated until the bound meets the target recall; all runs draw from one sketch, so the bound is
summed over the number of places a pair has in common, and holds what the candidate cut drops.

A pair is compared in one bucket only (the least of those that both sets reached), so links are
counted without listing pairs, and what leaves a bucket is a row per set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, SIMILAR = 5, (4, 5)  # shingle length; the least similarity, as a fraction
PLACES = 64  # min-hash values of a sketch
TARGET = 0.9999  # of the pairs at the least similarity
BUCKET = 128  # sets of a bucket that is compared without further splits
BLOCK = 256  # sets of a side of one comparison task
LEVELS = 12  # deeper buckets are compared as they are, in blocks
#: Part of the loss that the target allows which the candidate cut may take.
CUT_PART = 0.1
#: Sets that may be broadcast to the scan that fetches their texts.
BROADCAST_ROWS = 200_000
SKETCHES = "doc_id long, file string, row long, key string, sketch array<int>"
NEEDS = "leaf long, i int, j int, blk int, cid long, weight long, leaves array<long>"

_SEED = np.random.default_rng(20240229)
_A = (_SEED.integers(0, 1 << 32, PLACES, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _SEED.integers(0, 1 << 32, PLACES, np.uint64).astype(np.uint32)[:, None]
_MULTIPLIERS = [np.uint64(x | 1) for x in (0x9DDFEA08EB382D69, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x87C37B91114253D5, 0x4CF5AD432745937F, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F)]


def _common(m: int, similar: float) -> float:
    """How likely a pair of similarity ``similar`` has ``m`` places of the sketch in common."""
    return math.comb(PLACES, m) * similar**m * (1 - similar) ** (PLACES - m)


def cut_for(target: float, similar: float) -> int:
    """Places in common from which a pair is a candidate."""
    cut, below = 0, _common(0, similar)
    while below <= CUT_PART * (1 - target) and cut < PLACES:
        cut += 1
        below += _common(cut, similar)
    return cut


def loss(runs: int, similar: float, cut: int) -> float:
    """How likely a pair of similarity ``similar`` is never a candidate, however deep buckets are split.

    A pair with m places in common shares the first of two different places with probability
    s = m / PLACES and both with t = s (m - 1) / (PLACES - 1). A pair that is together at a bucket meets
    again below with probability 2 s q - t q^2, where q is the same for the next level:
    q = (2 s - 1) / t. Given m, and only then, runs are independent.
    """
    total = 0.0
    for m in range(PLACES + 1):
        s = m / PLACES
        q = max(0.0, 2 * s - 1) / (s * (m - 1) / (PLACES - 1)) if m > 1 else 0.0
        total += _common(m, similar) * ((1 - min(1.0, q)) ** runs if m >= cut else 1.0)
    return total


def runs_for(target: float, similar: float) -> int:
    """Runs after which a pair of the least similarity is a candidate with probability ``target``."""
    cut = cut_for(target, similar)
    if loss(1 << 20, similar, cut) > 1 - target:
        raise ValueError(f"sketches of {PLACES} places do not reach a recall of {target} at similarity {similar}")
    return next(r for r in range(1, 1 << 20) if loss(r, similar, cut) <= 1 - target)


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle has are one shingle, no words none."""
    raws = [t.encode() for t in texts]
    plain = np.frombuffer((b" ".join(raws) + b" ").translate(common.WORD_BYTES), np.uint8)
    begin, end = common.runs(plain != 32)
    doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raws], dtype=np.int64), begin, "right")
    word = common.ByteHash(plain).of(begin, end)
    n = np.bincount(doc, minlength=len(texts))
    total = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        total += word[k : len(word) - words + 1 + k] * _multiplier(k)
    total = common.mix(total)
    out, at = [], 0
    for size in n.tolist():
        if size >= words:
            out.append(np.unique(total[at : at + size - words + 1]))
        else:
            part = word[at : at + size]
            out.append(common.mix(sum((part[k : k + 1] * _multiplier(k) for k in range(1, size)), part[:1] * _multiplier(0))) if size else np.zeros(0, np.uint64))
        at += size
    return out


def _multiplier(k: int) -> np.uint64:
    return _MULTIPLIERS[k] if k < len(_MULTIPLIERS) else np.uint64(pow(int(_MULTIPLIERS[0]), k, 1 << 64))


def sketch(s: np.ndarray) -> np.ndarray:
    """Least value of each of PLACES hash functions over the set."""
    low = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(x), 4096):
        np.minimum(low, (_A * x[a : a + 4096] + _B).min(axis=1), out=low)
    return low


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks_of_bytes(batches, "text", 4_000_000):
            sets = shingles(batch.column("text").to_pylist(), words)
            keys = [f"{int(common.mix(s).sum(dtype=np.uint64)):016x}{int(common.mix(s ^ _MULTIPLIERS[1]).sum(dtype=np.uint64)):016x}" if len(s) else None for s in sets]
            low = np.stack([sketch(s) for s in sets]).view(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("row"), pa.array(keys, pa.string()),
                                              pa.ListArray.from_arrays(np.arange(0, low.size + 1, PLACES, dtype=np.int32), low.ravel())], [c.split()[0] for c in SKETCHES.split(", ")])

    return run


def _children(path, sketch_col):
    """The two buckets below ``path`` that a set falls into: two different places of the sketch, drawn by the path."""
    first = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(PLACES)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(path, F.lit(2)), F.lit(PLACES - 1)).cast("int"), F.lit(PLACES))
    return F.array(*(F.xxhash64(path, p, F.get(sketch_col, p)) for p in (first, second)))


def last_buckets(sets: DataFrame, runs: int, bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """cid, leaf, n: the buckets of two or more sets in which splitting stopped, over all runs. ``sets``: cid, sketch."""
    roots = F.explode(F.flatten(F.array(*(_children(F.lit(r).cast("long"), F.col("sketch")) for r in range(runs)))))
    rows = sets.select("cid", roots.alias("path"))
    live = common.written(rows.join(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "path"), "jaccard-level")
    done = live.where(F.col("n") <= bucket).select("cid", F.col("path").alias("leaf"), "n")
    big = live.where(F.col("n") > bucket)
    for _ in range(levels):
        if not big.take(1):
            return done
        below = big.join(sets, "cid").select("cid", F.col("path").alias("up"), F.col("n").alias("up_n"), F.explode(_children(F.col("path"), F.col("sketch"))).alias("path"))
        below = common.written(below, "jaccard-level")
        sizes = below.groupBy("up", "up_n", "path").agg(F.count(F.lit(1)).alias("n"))
        split = common.written(sizes.groupBy("up", "up_n").agg((F.sum(F.expr("cast(n as double) * n")) < F.expr("cast(up_n as double) * up_n")).alias("pays")), "jaccard-split")
        done = done.unionAll(big.join(split.where("NOT pays").select(F.col("up").alias("path")), "path", "left_semi").select("cid", F.col("path").alias("leaf"), "n"))
        kept = sizes.where("n > 1").join(split.where("pays").select("up"), "up", "left_semi").select("up", "path", "n")
        live = common.written(below.select("cid", "up", "path").join(kept, ["up", "path"]).select("cid", "path", "n"), "jaccard-level")
        done = done.unionAll(live.where(F.col("n") <= bucket).select("cid", F.col("path").alias("leaf"), "n"))
        big = live.where(F.col("n") > bucket)
    return done.unionAll(big.select("cid", F.col("path").alias("leaf"), "n"))


def _tasks(rows: DataFrame, block: int) -> DataFrame:
    """Large buckets in blocks: a task (leaf, i, j) compares block i with block j, or a block with itself."""
    count = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("cid", "leaf"), count).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")).drop("o", "n")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    flat = column.combine_chunks()
    return np.asarray(flat.offsets), np.asarray(flat.values)


def _earlier(leaf: int, offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A row of bits per set: which buckets below ``leaf`` it reached, of those that two sets or more did."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    values = values[offsets[0] : offsets[-1]]
    low = values < leaf
    names, at, count = np.unique(values[low], return_inverse=True, return_counts=True)
    use = count > 1
    place = np.cumsum(use) - 1
    bits = np.zeros((n, int(use.sum())), bool)
    shared = use[at]
    bits[owner[low][shared], place[at[shared]]] = True
    return bits


def _candidates(cut: int):
    """Per task, the sets that have a candidate pair (``cut`` places in common or more) which belongs to the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.grouped(batches, ["leaf", "i", "j"]):
            n, leaf = t.num_rows, t.column("leaf")[0].as_py()
            if n < 2:
                continue
            marks = _lists(t.column("sketch"))[1].reshape(n, PLACES) if t.column("sketch").num_chunks == 1 else np.stack([np.asarray(x.values) for x in t.column("sketch")])
            blk = np.asarray(t.column("blk").combine_chunks())
            cross = t.column("i")[0].as_py() != t.column("j")[0].as_py()
            bits = np.packbits(_earlier(leaf, *_lists(t.column("leaves"))), axis=1)
            hit = np.zeros(n, bool)
            for a in range(n - 1):
                near = np.count_nonzero(marks[a + 1 :] == marks[a], axis=1) >= cut
                if cross:
                    near &= blk[a + 1 :] != blk[a]
                if near.any():
                    b = np.flatnonzero(near) + a + 1
                    if bits.shape[1]:
                        b = b[~(bits[b] & bits[a]).any(axis=1)]
                    if len(b):
                        hit[a] = True
                        hit[b] = True
            if hit.any():
                yield from t.filter(pa.array(hit)).select([c.split()[0] for c in NEEDS.split(", ")]).combine_chunks().to_batches()

    return run


def _verified(least: tuple[int, int]):
    """Per task, exact similarities: each set's links, weighted by the rows they stand for, and the least set it hangs together with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.grouped(batches, ["leaf", "i", "j"]):
            n, leaf = t.num_rows, t.column("leaf")[0].as_py()
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles")]
            size = np.array([len(s) for s in sets])
            _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            place = np.cumsum(count > 1) - 1
            owner, at_use = np.repeat(np.arange(n), size), count[at] > 1
            owner, column = owner[at_use], place[at[at_use]]
            both = np.zeros((n, n), np.float32)
            order = np.argsort(column, kind="stable")
            owner, column = owner[order], column[order]
            for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
                lo, hi = np.searchsorted(column, (a, a + 4096))
                part = np.zeros((n, min(4096, int(column[-1]) + 1 - a)), np.float32)
                part[owner[lo:hi], column[lo:hi] - a] = 1
                both += part @ part.T
            both = both.astype(np.int64)
            link = least[1] * both >= least[0] * (size[:, None] + size[None, :] - both)
            np.fill_diagonal(link, False)
            bits = _earlier(leaf, *_lists(t.column("leaves"))).astype(np.float32)
            link &= ~((bits @ bits.T) > 0)
            blk = np.asarray(t.column("blk").combine_chunks())
            if t.column("i")[0].as_py() != t.column("j")[0].as_py():
                link &= blk[:, None] != blk[None, :]
            if not link.any():
                continue
            cid, weight = np.asarray(t.column("cid").combine_chunks()), np.asarray(t.column("weight").combine_chunks())
            root = cid.copy()
            while True:  # the least name spreads along links
                least_near = np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1)
                new = np.minimum(root, least_near)
                if (new == root).all():
                    break
                root = new
            use = link.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cid[use]), pa.array((link @ weight)[use]), pa.array(root[use])], ["cid", "links", "root"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks_of_bytes(batches, "text", 4_000_000):
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([s.tobytes() for s in shingles(batch.column("text").to_pylist(), words)], pa.binary())], ["cid", "shingles"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of ``edges`` (a, b). Stars are made larger and smaller in turn until nothing moves."""
    now = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "jaccard-edges")
    state = None
    while True:
        way = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = way.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = way.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = common.written(small, "jaccard-edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if new == state:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
        state = new


def links(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR, target: float = TARGET, bucket: int = BUCKET, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text",
          broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, class_id, n_links, rep_id, class_key, file, row: one row per row of ``docs``.

    Rows of equal shingle sets are one set; ``rep_id`` is its smallest doc_id. ``n_links`` counts the
    other rows whose Jaccard similarity is at least ``similar``, rows of the same set among them.
    ``class_id`` is the smallest doc_id of the rows that hang together by links. Texts of fewer words
    than a shingle are one shingle; null, empty and wordless texts resemble nothing and are classes of
    their own. Repeated ids are rows of their own; rows without an id are linked as others, and a class
    of such rows alone has no class_id. No rows in, none out. Extra columns are not read.
    """
    source = common.located(docs, id_col, text_col)
    rows = common.written(source.mapInArrow(_sketches(words), SKETCHES).withColumn("uid", F.monotonically_increasing_id()), "jaccard-sketches")
    least = similar[0] / similar[1]
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("weight"))
    classes = common.written(classes, "jaccard-classes")
    sets = common.written(rows.select(F.col("uid").alias("cid"), "sketch", "file", "row").join(classes.select("cid", "weight"), "cid"), "jaccard-sets")
    leaves = last_buckets(sets.select("cid", "sketch"), runs_for(target, least), bucket)
    reached = leaves.groupBy("cid").agg(F.collect_list(F.struct("leaf", "n")).alias("reached"))
    tasks = reached.join(sets.select("cid", "weight", "sketch"), "cid").select("cid", "weight", "sketch", F.col("reached.leaf").alias("leaves"), F.explode("reached").alias("at"))
    tasks = _tasks(tasks.select("cid", "weight", "sketch", "leaves", "at.leaf", "at.n"), block)
    placed = lambda df: df.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    needs = common.written(placed(tasks).mapInArrow(_candidates(cut_for(target, least)), NEEDS), "jaccard-needs")
    wanted = needs.select("cid").distinct().join(sets.select("cid", "file", "row"), "cid")
    wanted = common.written(wanted, "jaccard-wanted")
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    bodies = common.written(source.select("text", "file", "row").join(wanted, ["file", "row"]).select("cid", "text").mapInArrow(_sets(words), "cid long, shingles binary"), "jaccard-bodies")
    found = common.written(placed(needs.join(bodies, "cid")).mapInArrow(_verified(similar), "cid long, links long, root long"), "jaccard-links")
    count = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    info = classes.join(count, "cid", "left").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    first = info.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    info = info.join(first, "root").select("key", "class_id", "rep_id", "root", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    return rows.select("doc_id", "file", "row", "uid", "key").join(info, "key", "left").select(
        "doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id"), F.coalesce("root", "uid").alias("class_key"), "file", "row")


def keep(docs: DataFrame) -> DataFrame:
    """One row of each class stays, the one with the smallest doc_id (rows without an id last), with all its columns."""
    docs = common.backed(docs)
    found = common.written(links(docs), "jaccard-found")
    first = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")).alias("first"))
    return common.without(docs, found.join(first, "class_key").where("NOT (file = first.file AND row = first.row)").select("file", "row"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "rep_id")


QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLES: dict[str, str] = {}

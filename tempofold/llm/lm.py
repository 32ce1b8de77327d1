"""Language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood bigram estimate with the smoothed unigram one. The
weight depends on how often the context was seen (buckets by power of two) and is learned by
expectation-maximisation on held-out counts: every training token is scored with its own occurrence
taken out.

Counts follow the corpus, so they never meet in one place. A block of texts sends its distinct n-grams,
as sorted 64-bit keys coded by their gaps, to the key range that owns them; the owner adds up training
counts and sends the block its totals back, in the order the block asked. So each block is scored
where it is, and what is shuffled is a few bytes per distinct n-gram of a block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of text of a block, and of all blocks together per key range.
BLOCK_BYTES, RANGE_BYTES = 8_000_000, 8_000_000
#: Steps of log2(bigram / unigram estimate) in the statistics of EM, per unit, and their reach.
STEPS, REACH = 64, 32
END = np.uint64(0xE5D00D5E0F7E4D01)  # the end token, and the context of a first word
SPACE_BYTES = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
ROWS = "block string, r int, a binary, b binary, c binary, d binary, distinct long"
BLOCKS = "block string, docs binary, held binary, sizes binary, tokens binary, uni binary, bi binary, distinct long, train long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, the empty high planes left out."""
    x = np.ascontiguousarray(x, np.uint64)
    planes = x.view(np.uint8).reshape(-1, 8).T
    used = (int(x.max(initial=0)).bit_length() + 7) // 8
    return len(x).to_bytes(8, "little") + zstandard.compress(np.ascontiguousarray(planes[:used]).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(zstandard.decompress(data[8:]), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    if n:
        used = len(raw) // n
        out[:, :used] = raw.reshape(used, n).T
    return out.reshape(-1).view(np.uint64) if n else np.zeros(0, np.uint64)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order of appearance, and each value's place among them."""
    d = pa.array(x).dictionary_encode()
    return np.asarray(d.dictionary), np.asarray(d.indices).astype(np.int64)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text closed by END, and tokens per text. A megabyte of text at a time."""
    cuts, size = [0], 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > 1 << 20 or k == len(texts) - 1:
            cuts.append(k + 1)
            size = 0
    parts = [_tokens(texts[a:b]) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raws = [t.encode() for t in texts]
    plain = np.frombuffer((b" ".join(raws) + b" ").translate(SPACE_BYTES), np.uint8)
    begin, end = common.runs(plain != 32)
    stop = np.cumsum([len(r) + 1 for r in raws], dtype=np.int64)
    doc = np.searchsorted(stop, begin, "right")
    out = np.full(len(begin) + len(texts), END, np.uint64)
    out[np.arange(len(begin)) + doc] = common.ByteHash(plain).of(begin, end)
    return out, np.bincount(doc, minlength=len(texts)) + 1


def bigrams(seq: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Context and token as one number each; the context of a first token is the end token."""
    context = np.empty_like(seq)
    context[1:] = seq[:-1]
    context[np.cumsum(sizes) - sizes] = end
    return (context << 32) | seq


class Block:
    """Texts as places in their list of distinct tokens, and their distinct bigrams."""

    def __init__(self, docs: list[int | None], held: list[bool], texts: list[str]):
        self.docs, self.held = docs, np.array(held, bool)
        hashes, self.sizes = tokens(texts)
        self.uni, self.seq = coded(hashes)
        self.end = int(self.seq[-1])
        self.train = np.repeat(~self.held, self.sizes)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unigram and bigram keys and their training counts, in order of appearance."""
        pairs, at = coded(bigrams(self.seq, self.sizes, self.end))
        bi = common.mix(self.uni[pairs >> 32] * np.uint64(0xD6E8FEB86659FD93) + self.uni[pairs & 0xFFFFFFFF])
        return self.uni, np.bincount(self.seq[self.train], minlength=len(self.uni)), bi, np.bincount(at[self.train], minlength=len(bi))


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, Block]]:
    part, docs, held, texts, size, n = TaskContext.get().partitionId(), [], [], [], 0, 0
    for batch in itertools.chain(common.blocks_of_bytes(batches, "text", limit), [None]):
        if batch is not None:
            docs += batch.column("doc_id").to_pylist()
            held += batch.column("held").to_pylist()
            texts += batch.column("text").to_pylist()
            size += batch.column("text").nbytes
        if texts and (batch is None or size >= limit):
            b = Block(docs, held, texts)
            # The name holds a digest: the two passes over the texts must cut the same blocks.
            digest = int(np.bitwise_xor.reduce(common.mix(b.uni[b.seq] + np.arange(len(b.seq), dtype=np.uint64))))
            yield f"{part}-{n}-{digest:x}", b
            docs, held, texts, size, n = [], [], [], 0, n + 1


def _ranges(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and where each range begins in it. A range is an equal part of all 64-bit keys."""
    order = np.argsort(keys)
    owner = (keys[order] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return order, np.searchsorted(owner, np.arange(ranges + 1, dtype=np.uint64))


def _ask(ranges: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, b in _blocks(batches, limit):
            uni, uni_n, bi, bi_n = b.keys()
            (ou, cu), (ob, cb) = _ranges(uni, ranges), _ranges(bi, ranges)
            rows = []
            for r in range(ranges):
                u, v = ou[cu[r] : cu[r + 1]], ob[cb[r] : cb[r + 1]]
                if not len(u) and not len(v):  # never more rows than keys, however many ranges
                    continue
                gaps = lambda k: pack(np.diff(k, prepend=np.uint64(0)))
                rows.append((name, r, gaps(uni[u]), pack(uni_n[u]), gaps(bi[v]), pack(bi_n[v]), 0))
            yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in ROWS.split(", ")])


def _answer(group: pa.Table) -> pa.Table:
    """The total training counts of one key range, for each block in the order of its keys."""
    group = group.sort_by("block")
    out = [[], []]
    distinct = 0
    for k, (keys, counts) in enumerate((("a", "b"), ("c", "d"))):
        parts = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in group.column(keys)]
        own = np.concatenate([unpack(x.as_py()) for x in group.column(counts)])
        edges = np.cumsum([0, *map(len, parts)])
        d = pa.array(np.concatenate(parts)).dictionary_encode()
        del parts
        at, n = np.asarray(d.indices), len(d.dictionary)
        total = np.bincount(at, own.astype(float), n).astype(np.uint64)
        del d, own
        if k == 0:
            distinct = int(np.count_nonzero(total))
        out[k] = [pack(total[at[a:b]]) for a, b in zip(edges, edges[1:])]
    rows = [(n, r, u, None, b, None, distinct if i == 0 else 0) for i, (n, r, u, b) in enumerate(zip(group.column("block").to_pylist(), group.column("r").to_pylist(), *out))]
    return pa.Table.from_batches([_rows(rows)])


def _own(limit: int):
    """The blocks themselves, as rows that meet their answers: documents, held flags, sizes and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, b in _blocks(batches, limit):
            docs = pa.array(b.docs, pa.int64())
            ids = np.asarray(docs.fill_null(0)).astype("<i8")
            state = np.where(b.held, 1, 0) + np.where(np.asarray(docs.is_null()), 2, 0)
            yield _rows([(name, -1, ids.tobytes(), pack(state), pack(b.sizes), pack(b.uni) + b"\x1e" + pack(b.seq) + len(pack(b.uni)).to_bytes(8, "little"), 0)])

    return run


def _met(ranges: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("r")
        own = {k: group.column(k)[0].as_py() for k in "abcd"}
        n = int.from_bytes(own["d"][-8:], "little")
        uni, seq = unpack(own["d"][:n]), unpack(own["d"][n + 1 : -8]).astype(np.int64)
        sizes, state = unpack(own["c"]).astype(np.int64), unpack(own["b"])
        pairs, _ = coded(bigrams(seq, sizes, int(seq[-1])))
        bi = common.mix(uni[pairs >> 32] * np.uint64(0xD6E8FEB86659FD93) + uni[pairs & 0xFFFFFFFF])
        totals, asked = [], np.zeros(ranges, bool)
        for keys in (uni, bi):
            asked |= np.diff(_ranges(keys, ranges)[1]) > 0
        if group.column("r").to_pylist() != [-1, *np.flatnonzero(asked).tolist()]:
            raise ValueError(f"block {group.column('block')[0]} was answered by other ranges than it asks: the texts were not cut as before")
        for keys, name in ((uni, "a"), (bi, "c")):
            order, _ = _ranges(keys, ranges)
            total = np.empty(len(keys), np.uint64)
            total[order] = np.concatenate([unpack(x.as_py()) for x in group.column(name)[1:]])
            totals.append(total)
        row = (group.column("block")[0].as_py(), own["a"], own["b"], own["c"], pack(seq), pack(totals[0]), pack(totals[1]), sum(group.column("distinct").to_pylist()), int(sizes[state % 2 == 0].sum()))
        kinds = [pa.string(), *[pa.binary()] * 6, pa.int64(), pa.int64()]
        return pa.table({c.split()[0]: pa.array([v], k) for c, v, k in zip(BLOCKS.split(", "), row, kinds)})

    return run


class Counted:
    """A block whose totals are known: per distinct bigram the counts of bigram, context and token."""

    def __init__(self, row: dict):
        self.docs, state, self.sizes = np.frombuffer(row["docs"], "<i8"), unpack(row["held"]), unpack(row["sizes"]).astype(np.int64)
        self.held, self.null = state % 2 == 1, state >= 2
        seq, uni, self.both = unpack(row["tokens"]).astype(np.int64), unpack(row["uni"]).astype(float), unpack(row["bi"]).astype(float)
        pairs, self.at = coded(bigrams(seq, self.sizes, int(seq[-1])))
        self.context, self.token = uni[pairs >> 32], uni[pairs & 0xFFFFFFFF]
        self.train = np.repeat(~self.held, self.sizes)


def bucket(context: np.ndarray) -> np.ndarray:
    """Contexts by power of two of their count; 0: never seen."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def held_out(both, context, token, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and unigram estimates of training tokens, each with its own occurrence taken out."""
    return np.where(context > 1, (both - 1) / np.maximum(context - 1, 1), 0.0), (token - 0.5) / (n - 1 + 0.5 * (v + 1))


def _statistics(n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Counted(row)
                weight = np.bincount(b.at[b.train], minlength=len(b.both))
                use = weight > 0
                two, one = held_out(b.both[use], b.context[use], b.token[use], n, v)
                step = np.where(two > 0, np.clip(np.rint(STEPS * np.log2(np.maximum(two, 1e-300) / one)), 1 - STEPS * REACH, STEPS * REACH), -STEPS * REACH)
                cell, at = np.unique(bucket(b.context[use]) * (4 * STEPS * REACH) + step.astype(np.int64) + STEPS * REACH, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.bincount(at, weight[use], len(cell)).astype(np.int64))], ["cell", "n"])

    return run


def mixture(cells: list[tuple[int, int]], rounds: int = 200) -> dict[int, float]:
    """Weight of the bigram estimate per bucket, by EM. The lowest cell of a bucket holds tokens whose bigram was seen nowhere else."""
    by: dict[int, list[tuple[float, int]]] = {}
    for cell, n in cells:
        step = cell % (4 * STEPS * REACH) - STEPS * REACH
        by.setdefault(cell // (4 * STEPS * REACH), []).append((0.0 if step == -STEPS * REACH else 2.0 ** (step / STEPS), n))
    out = {}
    for k, rows in by.items():
        ratio, n = np.array([x for x, _ in rows]), np.array([x for _, x in rows], float)
        w = 0.5
        for _ in range(rounds):
            new = float((n * w * ratio / (w * ratio + 1 - w)).sum() / n.sum())
            if abs(new - w) < 1e-9:
                break
            w = min(new, 1 - 1e-9)
        out[k] = w
    return out


def _score(n: int, v: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Counted(row)
                one = (b.token + 0.5) / (n + 0.5 * (v + 1))
                w = weights[bucket(b.context)]
                mixed = w * b.both / np.maximum(b.context, 1) + (1 - w) * one
                doc = np.repeat(np.arange(len(b.sizes)), b.sizes)
                total = lambda x: np.bincount(doc, x[b.at], len(b.sizes))
                yield pa.RecordBatch.from_arrays([pa.array(b.docs, mask=b.null), pa.array(b.held), pa.array(b.sizes), pa.array(total((b.token > 0).astype(float)).astype(np.int64)),
                                                  pa.array(np.full(len(b.sizes), n)), pa.array(total(np.log10(one))), pa.array(total(np.log10(mixed)))], [c.split()[0] for c in SCORES.split(", ")])

    return run


def score(docs: DataFrame, held=None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``held`` marks rows that are scored but not learned from (default: none). Tokens are A-Z
    lower-cased runs without white space and one end per text; null texts are empty: an end alone. Rows
    that repeat an id, or have none, count and score each on its own. With nothing to learn from every
    token has probability one. No rows in, none out. Extra columns are not read.
    """
    spark = docs.sparkSession
    # The two passes need the same rows in the same place.
    docs = common.backed(docs.select(F.col(id_col), F.col(text_col), (held if held is not None else F.lit(False)).alias("_held")))
    rows = common.texts(docs, id_col, text_col, held=F.coalesce("_held", F.lit(False)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(2, -(-size // range_bytes))  # a range holds as much, however large the corpus
    answers = rows.mapInArrow(_ask(ranges, block_bytes), ROWS).groupBy("r").applyInArrow(_answer, ROWS)
    blocks = common.written(rows.mapInArrow(_own(block_bytes), ROWS).unionAll(answers).groupBy("block").applyInArrow(_met(ranges), BLOCKS), "lm-blocks")
    v, n = (int(x or 0) for x in blocks.agg(F.sum("distinct"), F.sum("train")).first())
    cells = blocks.mapInArrow(_statistics(n, v), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    learned = mixture([tuple(r) for r in cells.collect()])  # at most 65 buckets of 4,096 steps
    weights = np.zeros(66)
    for k, w in learned.items():
        weights[k] = w
    weights[0] = 0.0
    return blocks.mapInArrow(_score(n, v, weights), SCORES)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.fold(F.col("doc_id")) == 1)


QUERIES = {"op4_lm_score": op4_lm_score}
ORACLES: dict[str, str] = {}

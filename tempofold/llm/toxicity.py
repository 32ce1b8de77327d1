"""Toxicity by multiple-instance learning.

Only documents are labelled. A sentence scores by a logistic over its words and word beginnings, a
document by noisy-or over its sentences; both are trained together from the document labels, so the
sentences that give offence can be told from the rest of their document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the labelled documents that are learned from (half from each label at most), and of the features kept.
SAMPLE, FEATURES = 20_000, 20_000
#: Characters of word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6)
SCHEMA = "doc_id long, score double, spans array<struct<start:long,end:long,score:double>>"
ENDS = np.isin(np.arange(256), [10, 13, 33, 46, 63])  # line ends . ! ?


class Read:
    """One buffer of texts: its words, their features, their sentences, and each sentence's text and place."""

    def __init__(self, texts: list[str]):
        raws = [t.encode() for t in texts]
        joined = b"\n".join(raws) + b"\n"
        self.raw = np.frombuffer(joined, np.uint8)
        plain = np.frombuffer(joined.translate(common.WORD_BYTES), np.uint8)
        begin, end = common.runs(plain != 32)
        text_end = np.cumsum([len(r) + 1 for r in raws], dtype=np.int64)
        # A sentence ends at its mark; the line feed between texts is one too.
        mark = np.cumsum(ENDS[self.raw])
        sentence = mark[begin] if len(begin) else np.zeros(0, np.int64)
        self.sentence_ids, self.sentence = np.unique(sentence, return_inverse=True)
        first = np.flatnonzero(np.diff(sentence, prepend=-1)) if len(sentence) else np.zeros(0, np.int64)
        self.doc = np.searchsorted(text_end, begin[first], "right") if len(first) else np.zeros(0, np.int64)
        self.start = begin[first] if len(first) else begin
        self.end = end[np.append(first[1:], len(begin)) - 1] if len(first) else end
        self.text_start = text_end - [len(r) + 1 for r in raws] if raws else text_end
        hashes = common.ByteHash(plain)
        keys, owner = [hashes.of(begin, end)], [np.arange(len(begin))]
        for n in BEGINNINGS:
            long = np.flatnonzero(end - begin >= n)
            keys.append(hashes.of(begin[long], begin[long] + n) ^ np.uint64(0xA5A5A5A5 * n))
            owner.append(long)
        self.keys, owner = np.concatenate(keys), np.concatenate(owner)
        self.key_sentence = self.sentence[owner] if len(begin) else owner
        self.n_docs = len(texts)

    def chars(self, doc: int, at: int) -> int:
        """A byte place as a character place within its text."""
        a = int(self.text_start[doc])
        return int(np.count_nonzero((self.raw[a:at] & 0xC0) != 0x80))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, positives, negatives: in how many documents of each label a feature stands, summed per task."""
    pos: list[np.ndarray] = []
    neg: list[np.ndarray] = []
    for batch in common.blocks_of_bytes(batches, "text", 4_000_000):
        read = Read(batch.column("text").to_pylist())
        label = np.asarray(batch.column("label")).astype(bool)
        doc = read.doc[read.key_sentence] if len(read.keys) else np.zeros(0, np.int64)
        pair = np.unique(np.stack([doc.astype(np.uint64), read.keys]), axis=1)
        is_pos = label[pair[0].astype(np.int64)]
        pos.append(pair[1][is_pos])
        neg.append(pair[1][~is_pos])
    keys = np.concatenate([*pos, *neg]) if pos else np.zeros(0, np.uint64)
    if len(keys):
        uniq, at = np.unique(keys, return_inverse=True)
        n = sum(map(len, pos))
        a, b = np.bincount(at[:n], minlength=len(uniq)), np.bincount(at[n:], minlength=len(uniq))
        yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["key", "pos", "neg"])


def _bags(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document its label and, per sentence with any, the places of its kept features; sentences end with -1."""
        kept = shared.value
        for batch in common.blocks_of_bytes(batches, "text", 4_000_000):
            read = Read(batch.column("text").to_pylist())
            at = np.minimum(np.searchsorted(kept, read.keys), len(kept) - 1)
            hit = kept[at] == read.keys
            row = np.unique(np.stack([read.key_sentence[hit], at[hit]]), axis=1)
            bags: list[list[int]] = [[] for _ in range(read.n_docs)]
            for k in np.split(np.arange(row.shape[1]), np.flatnonzero(np.diff(row[0])) + 1):
                if len(k):
                    bags[int(read.doc[row[0][k[0]]])].extend([*row[1][k].tolist(), -1])
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.int32())), batch.column("label")], ["bag", "label"])

    return run


class Model:
    """Sorted feature keys, their weights, the bias of a sentence that has any, and the leak of every document."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, leak: float):
        self.keys, self.weights, self.bias, self.leak = keys, weights, bias, leak

    @classmethod
    def again(cls, state: dict) -> Model:
        """A model from what was broadcast: plain values, which workers without this package can read."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def sentences(self, read: Read) -> tuple[np.ndarray, np.ndarray]:
        """Sentences with a known feature, and their probability."""
        if not len(self.keys) or not len(read.keys):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.keys, read.keys), len(self.keys) - 1)
        hit = self.keys[at] == read.keys
        pair = np.unique(np.stack([read.key_sentence[hit], at[hit]]), axis=1)
        which, place = np.unique(pair[0], return_inverse=True)
        return which, 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(place, self.weights[pair[1]], len(which)), -30, 30)))


def fit(bags: list[tuple[list[int], int]], keys: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 2e-3) -> Model:
    """Noisy-or over sentences, by gradient on the documents' likelihood. 1 - p(doc) = (1 - leak) * product of (1 - p(sentence))."""
    label = np.array([y for _, y in bags], float)
    feat, sent, owner, s = [], [], [], 0
    for d, (bag, _) in enumerate(bags):
        for f in bag:
            if f < 0:
                owner.append(d)
                s += 1
            else:
                feat.append(f)
                sent.append(s)
    feat, sent, owner = (np.array(x, np.int64) for x in (feat, sent, owner))
    w, b, leak = np.zeros(len(keys)), -2.0, -4.0
    m, v = np.zeros(len(keys) + 2), np.zeros(len(keys) + 2)
    n_pos = max(1.0, label.sum())
    for t in range(1, rounds + 1):
        z = b + np.bincount(sent, w[feat], s)
        p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        l0 = 1 / (1 + np.exp(-leak))
        none = np.log1p(-l0) + np.bincount(owner, np.log1p(-p), len(label))
        off = np.clip(np.exp(none), 1e-12, 1 - 1e-12)
        # d/dz of log p(doc): p * off / (1 - off) if labelled 1, else -p
        pull = np.where(label > 0, off / (1 - off), -1.0)
        gz = p * pull[owner]
        grad = np.concatenate([np.bincount(feat, gz[sent], len(keys)), [gz.sum(), l0 * pull.sum()]]) / n_pos - decay * np.concatenate([w, [0, 0]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b, leak = w + step[:-2], b + step[-2], leak + step[-1]
    use = np.abs(w) > 1e-3
    return Model(keys[use], w[use], float(b), float(min(0.4, 1 / (1 + np.exp(-leak)))))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from texts and the labels of some of them. About ``sample`` / 2 documents of each label at most, drawn by hash of the id; at most ``features`` features.

    Labels without an id or a value are left out, repeated labels of one id count as their largest.
    Features are words and word beginnings that stand in two or more documents of label 1 and there
    at least four times as often as elsewhere. Without labels, or without label 1, every text scores 0.01.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label_col) != 0).alias("label"))
    sizes = {r[0]: r[1] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if True not in sizes:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.01)
    chance = {k: min(1.0, sample / 2 / n) for k, n in sizes.items()}
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 33) / F.lit(float(1 << 31))
    ids = marks.where(u < F.when(F.col("label"), chance[True]).otherwise(chance.get(False, 0.0)))
    # The drawn ids are bounded by ``sample``, so they go to the texts and no text is shuffled.
    drawn = common.written(common.texts(docs, id_col, text_col).join(F.broadcast(ids), "doc_id").select("text", "label"), "toxicity-sample")
    n_pos, n_neg = sizes[True] * chance[True], max(1.0, sizes.get(False, 0) * chance.get(False, 0.0))
    counts = drawn.mapInArrow(_features, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lift = F.log(((F.col("pos") + 0.1) / n_pos) / ((F.col("neg") + 0.1) / n_neg))
    best = counts.where("pos >= 2").withColumn("lift", lift).where(F.col("lift") > float(np.log(4))).orderBy((F.col("lift") * F.sqrt("pos")).desc(), "key").limit(features).select("key").collect()
    keys = np.unique(np.array([r[0] for r in best], np.int64).view(np.uint64))
    if not len(keys):
        return Model(keys, np.zeros(0), 0.0, 0.01)
    shared = spark.sparkContext.broadcast(keys)
    bags = [(r[0], int(r[1])) for r in drawn.mapInArrow(_bags(shared), "bag array<int>, label boolean").toLocalIterator()]
    model = fit(bags, keys)
    # The draw may hold fewer of label 0 than there are; the leak is a rate among all documents.
    model.leak *= min(1.0, (n_pos + n_neg) / max(1, sizes[True] + sizes.get(False, 0)))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", locate: float = 0.5) -> DataFrame:
    """doc_id, score, spans of the sentences at ``locate`` or above (characters). Null and empty texts score the leak, as do texts without a known feature."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    return common.texts(docs, id_col, text_col).mapInArrow(_score(shared, locate), SCHEMA)


def _probabilities(read: Read, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    which, p = model.sentences(read)
    none = np.log1p(-model.leak) + np.bincount(read.doc[which], np.log1p(-np.minimum(p, 1 - 1e-12)), read.n_docs) if len(which) else np.full(read.n_docs, np.log1p(-model.leak))
    return -np.expm1(none), which, p


def _score(shared, locate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.again(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in common.blocks_of_bytes(batches, "text", 4_000_000):
            read = Read(batch.column("text").to_pylist())
            total, which, p = _probabilities(read, model)
            spans: list[list[dict]] = [[] for _ in range(read.n_docs)]
            for s, q in zip(which[p >= locate].tolist(), p[p >= locate].tolist()):
                d = int(read.doc[s])
                spans[d].append({"start": read.chars(d, int(read.start[s])), "end": read.chars(d, int(read.end[s])), "score": q})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return run


def clean(docs: DataFrame, model: Model, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """The rows that score below ``at``, with all their columns: a filter in one pass, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.again(shared.value)
        for batch in common.blocks_of_bytes(batches, text_col, 4_000_000):
            total, _, _ = _probabilities(Read([t or "" for t in batch.column(text_col).to_pylist()]), model)
            yield batch.filter(pa.array(total < at))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held = common.fold(F.col("doc_id")) == 0
    model = learn(docs.where(~held), labels.where(common.fold(F.col("doc_id")) != 0))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}

"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built; a text is cut greedily into the longest
phrases that the automaton knows. The language that needs the fewest phrases, each priced at the
logarithm of its sample's length, wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bounds of what is learned from: characters of all languages together, of one language, and of one document.
TOTAL_CHARS, LANGUAGE_CHARS, SNIPPET = 400_000, 40_000, 500
#: A text is parsed in strips of so many characters; a phrase never crosses the edge of a strip.
STRIP = 256
#: So many of the most frequent letters have a column of their own in the move table; edges by further letters are searched.
NEAR = 250
SCHEMA = "doc_id long, lang_pred string, score double, phrases array<long>"
SPACE, OTHER = 0, 1


def letters() -> np.ndarray:
    """Which code points are letters, as bits."""
    out = np.zeros(0x110000, bool)
    for a in range(0, 0x110000, 4096):
        out[a : a + 4096] = [chr(c).isalpha() for c in range(a, a + 4096)]
    return np.packbits(out)


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Lower-cased letters by ``table``; what is no letter is one space, runs of it once, none at the start."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = table[points]
    gap = out == SPACE
    gap[1:] &= out[:-1] == SPACE
    gap[:1] = out[:1] == SPACE
    return out[~gap]


def automaton(word: list[int]) -> np.ndarray:
    """Suffix automaton of a sequence: rows (state, symbol, next state); state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in word:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return np.array([(s, c, t) for s, row in enumerate(moves) for c, t in row.items()], np.int32).reshape(-1, 3)


class Moves(NamedTuple):
    """All languages' automata: a dense table for near letters, sorted (place, symbol) keys for further ones."""

    near: np.ndarray
    symbols: int
    keys: np.ndarray
    to: np.ndarray

    def further(self, place: np.ndarray, symbol: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Entries like those of the table, for (languages x texts) places and the further symbol each text comes to."""
        to, again = self._find(place.astype(np.int64), symbol), self._find(starts.astype(np.int64)[:, None], symbol)
        return np.where(to >= 0, to * 2, np.where(again >= 0, again, starts[:, None]) * 2 + 1)

    def _find(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = place * self.symbols + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


class Model:
    """Languages, symbol table and automata. Travels as edge lists; tasks spread them into a table. Every letter of the samples is a symbol."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs, self.letters = sorted(samples), letters()
        seen: dict[str, int] = {}
        for texts in samples.values():
            for t in texts:
                for c in t.lower():
                    if c.isalpha():
                        seen[c] = seen.get(c, 0) + 1
        self.alphabet = sorted(seen, key=lambda c: (-seen[c], c))
        table = self.table()
        self.edges, self.cost = [], []
        for lang in self.langs:
            word = np.concatenate([symbols(t + " ", table) for t in samples[lang]])
            self.edges.append(automaton(word.tolist()))
            self.cost.append(float(np.log2(len(word) + 2)))

    @classmethod
    def again(cls, state: dict) -> Model:
        """A model from what was broadcast: plain values, which workers without this package can read."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def table(self) -> np.ndarray:
        out = np.where(np.unpackbits(self.letters), OTHER, SPACE).astype(np.uint8 if len(self.alphabet) <= NEAR else np.int32)
        for k, c in enumerate(self.alphabet):
            out[ord(c)] = k + 2
        return out

    def dense(self) -> tuple[Moves, np.ndarray]:
        """The moves of all languages, and each one's start.

        An entry of the table is the next place in it, doubled, plus one where a phrase ends: the symbol
        cannot be added, so it starts the next phrase. The last column stays in place: it fills up
        short strips, and further letters wait there for their edge to be found.
        """
        fill, symbols = min(len(self.alphabet), NEAR) + 2, len(self.alphabet) + 3
        width = fill + 1
        tables, keys, to, starts, base = [], [], [], [], 0
        for edges in self.edges:
            n = int(edges[:, 2].max(initial=0)) + 1
            near = edges[edges[:, 1] < fill]
            move = np.full((n, width), -1, np.int64)
            move[near[:, 0], near[:, 1]] = near[:, 2]
            root = np.where(move[0] < 0, 0, move[0])
            out = np.where(move < 0, (base + root * width) * 2 + 1, (base + move * width) * 2)
            out[:, fill] = (base + np.arange(n) * width) * 2
            tables.append(out.astype(np.int32).ravel())
            far = edges[edges[:, 1] >= fill].astype(np.int64)
            keys.append((base + far[:, 0] * width) * symbols + far[:, 1])
            to.append(base + far[:, 2] * width)
            starts.append(base)
            base += n * width
        if not tables:
            return Moves(np.zeros(0, np.int32), symbols, np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int32)
        key = np.concatenate(keys)
        order = np.argsort(key)
        return Moves(np.concatenate(tables), symbols, key[order], np.concatenate(to)[order]), np.array(starts, np.int32)


def phrases(texts: list[str], model: Model, table: np.ndarray, moves: Moves, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) phrase counts, and symbols of each text. All strips take their steps side by side."""
    coded = [symbols(t, table) for t in texts]
    size = np.array([len(c) for c in coded], np.int64)
    strips = -(-size // STRIP)
    total, langs, fill, pad = int(strips.sum()), len(model.langs), min(len(model.alphabet), NEAR) + 2, len(model.alphabet) + 2
    grid = np.full(total * STRIP, pad, table.dtype)
    at = 0
    for c, n in zip(coded, strips):
        grid[at * STRIP : at * STRIP + len(c)] = c
        at += int(n)
    steps = np.ascontiguousarray(grid.reshape(total, STRIP).T)
    state = np.repeat(starts, total).reshape(langs, total)
    count, jump = np.ones((langs, total), np.int32), np.empty((langs, total), np.int32)
    for row in steps:
        state += row if pad == fill else np.minimum(row, fill)
        np.take(moves.near, state, out=jump, mode="clip")
        if pad > fill and len(far := np.flatnonzero((row >= fill) & (row < pad))):
            jump[:, far] = moves.further(jump[:, far] >> 1, row[far], starts)
        count += jump & 1
        np.right_shift(jump, 1, out=state)
    owner = np.repeat(np.arange(len(texts)), strips)
    return np.stack([np.bincount(owner, weights=c, minlength=len(texts)) for c in count], 1).astype(np.int64) if langs else np.zeros((len(texts), 0), np.int64), size


def learn(rows: DataFrame, total_chars: int = TOTAL_CHARS, language_chars: int = LANGUAGE_CHARS, snippet: int = SNIPPET) -> Model:
    """A model from (doc_id, text, lang). Per language, documents are drawn by hash of id and text until the bound is met.

    The bounds hold whatever the corpus: a document gives a snippet from its middle, a language
    ``language_chars``, all languages ``total_chars`` (more languages, shorter samples).
    """
    rows = rows.where("lang IS NOT NULL AND length(text) > 0").select("text", "lang", F.xxhash64("doc_id", "text").alias("at"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model({})
    share = min(language_chars, total_chars // len(sizes))
    want = max(1, 4 * share // snippet)  # short documents fill less than a snippet
    limit = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * want / n)))])
    draw = rows.where((F.shiftrightunsigned("at", 33) / F.lit(float(1 << 31))) < limit[F.col("lang")])
    piece = F.expr(f"substring(text, cast(greatest((length(text) - {snippet}) / 2, 0) as int) + 1, {snippet})")
    draw = draw.select("lang", "at", piece.alias("piece")).withColumn("k", F.expr("row_number() over (partition by lang order by at, piece)")).where(F.col("k") <= want)
    samples: dict[str, list[str]] = {}
    left = dict.fromkeys(sizes, share)
    for lang, text in draw.orderBy("lang", "k").select("lang", "piece").toLocalIterator():
        if left[lang] > 0:
            samples.setdefault(lang, []).append(text[: left[lang]])
            left[lang] -= len(text)
    return Model(samples)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, phrases (by language in order of name) for every row.

    ``und`` with score 0 for null texts, texts without a letter, and by a model without languages.
    The score is one minus the best price over the second best (0: a tie, which the earlier name
    wins; 1 with one language). Extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_predict(shared), SCHEMA)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.again(shared.value)
        table, (moves, starts) = model.table(), model.dense()
        cost = np.array(model.cost)
        for batch in common.blocks_of_bytes(batches, "text", 4_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, size = phrases(texts, model, table, moves, starts)
            price = counts * cost
            order = np.argsort(price, axis=1, kind="stable")
            known = (size > 0) & (len(model.langs) > 0)
            pred = [model.langs[o[0]] if k else "und" for o, k in zip(order, known)]
            if len(model.langs) > 1:
                sort = np.sort(price, axis=1)
                score = np.where(known, 1 - sort[:, 0] / np.maximum(sort[:, 1], 1e-9), 0.0)
            else:
                score = known.astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(list(counts), pa.list_(pa.int64()))],
                                             ["doc_id", "lang_pred", "score", "phrases"])

    return run


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = common.fold(F.col("doc_id")) == 0
    model = learn(common.texts(docs, lang=F.col("lang")).where(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
ORACLES: dict[str, str] = {}

"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark text.

Every window of ten consecutive words of an item is a pattern. Each text is scanned once; matches
carry word places, and those map back to character offsets of the text as it came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Item text that one automaton may hold; more items go to further automata, each scanned in turn.
BLOCK_CHARS = 8_000_000
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
PARTIAL = "doc_id long, row long, n_words long, items array<string>, runs array<struct<first:long,last:long,start:long,end:long>>"


def patterns(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> dict[str, list[str]]:
    """Window text -> ids of the items that hold it. Items of fewer words are one window; items without words none."""
    out: dict[str, list[str]] = {}
    for item, text in items:
        words = (text or "").encode().translate(common.WORD_BYTES).decode("latin-1").split(" ")
        words = [w for w in words if w]
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            ids = out.setdefault(f" {' '.join(words[i : i + size])} ", [])
            if item is not None and item not in ids:
                ids.append(item)
    return out


def scanner(found: dict[str, list[str]]):
    """text -> (words, items, hit word runs with character offsets)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for pattern, ids in found.items():
        machine.add_word(pattern, (pattern.count(" ") - 1, ids))
    if found:
        machine.make_automaton()

    def scan(text: str) -> tuple[int, list[str], list[dict]]:
        raw = text.encode()
        plain = raw.translate(common.WORD_BYTES)
        words = plain.split()
        if not words or not found:
            return len(words), [], []
        hay = b" " + b" ".join(words) + b" "
        hits = list(machine.iter(hay.decode("latin-1")))
        if not hits:
            return len(words), [], []
        gaps = np.flatnonzero(np.frombuffer(hay, np.uint8) == 32)
        last = np.searchsorted(gaps, [e for e, _ in hits]) - 1
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, last + 1 - [n for _, (n, _) in hits], 1)
        np.add.at(cover, last + 1, -1)
        first, stop = common.runs(np.cumsum(cover)[:-1] > 0)
        begin, end = common.runs(np.frombuffer(plain, np.uint8) != 32)
        heads = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))  # bytes before -> characters before
        spans = [{"first": int(a), "last": int(b) - 1, "start": int(heads[begin[a]]), "end": int(heads[end[b - 1]])} for a, b in zip(first, stop)]
        return len(words), sorted({i for _, (_, ids) in hits for i in ids}), spans

    return scan


def _blocks(benchmark: DataFrame, block_chars: int) -> list[list[tuple]]:
    """The items in blocks of bounded size. Only a block at a time need fit beside a scan."""
    blocks, size = [[]], 0
    for row in benchmark.toLocalIterator():
        n = len(row[1] or "")
        if blocks[-1] and size + n > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((row[0], row[1]))
        size += n
    return blocks


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: word count, hit words, items found (sorted as strings), hit spans in characters.

    Null or wordless text: zero words, no hit. A null benchmark text has no windows; an item without an
    id hits words but is not listed. Repeated items count once, repeated documents stay rows of their
    own. An empty table on either side gives no hits, or no rows. Columns besides the named are not read.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    # The benchmark is small beside the corpus, but its size is checked: each block is one automaton.
    blocks = [patterns(b, window) for b in _blocks(items, block_chars)]
    source = common.texts(docs, id_col, text_col)
    if len(blocks) == 1:
        found = source.mapInArrow(_scan(docs.sparkSession, blocks[0]), PARTIAL)
        merged = F.col("runs")
    else:  # every block over all texts, then the runs of a text meet on its row
        base = common.written(source.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
        parts = [base.mapInArrow(_scan(docs.sparkSession, b), PARTIAL) for b in blocks]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionAll(p)
        found = union.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                                         F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))
        merged = _merged("runs")
    kept = found.select("doc_id", "n_words", "items", merged.alias("runs"))
    return kept.select("doc_id", "n_words", F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1).alias("n_hit"), "items",
                       F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The rows without a hit, with all their columns: a filter per block of items, without a shuffle."""
    items = benchmark.select(F.lit(None).cast("string").alias("item"), F.col(item_text).alias("text"))
    for block in _blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(patterns(block, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scan = scanner(shared.value)
            for batch in common.blocks_of_bytes(batches, text_col, 8_000_000):
                yield batch.filter(pa.array([not scan(t or "")[2] for t in batch.column(text_col).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _merged(runs: str):
    """Sorted runs of words, those that touch or overlap joined."""
    kind = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
    return F.expr(f"""aggregate({runs}, cast(array() as {kind}), (a, r) -> case
        when size(a) > 0 and element_at(a, -1).last + 1 >= r.first
        then concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, r.last),
             'start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, r.end))))
        else concat(a, array(r)) end)""")


def _scan(spark: SparkSession, found: dict[str, list[str]]):
    shared = spark.sparkContext.broadcast(found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = scanner(shared.value)
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())),
                            ("runs", pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")])))])
        for batch in common.blocks_of_bytes(batches, "text", 8_000_000):
            rows = [run(t) for t in batch.column("text").to_pylist()]
            own = batch.column("row") if "row" in batch.schema.names else pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), own, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], schema.field("items").type),
                                              pa.array([r[2] for r in rows], schema.field("runs").type)], schema=schema)

    return scan


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS k, array_to_string(ws[i : i + least(len(ws), {WINDOW}) - 1], ' ') AS g
        FROM b, range(1, greatest(len(ws) - least(len(ws), {WINDOW}) + 2, 1)) t(i) WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM win),
occ AS (SELECT d.doc_id, ks.k, i, array_to_string(ws[i : i + ks.k - 1], ' ') AS g FROM d, ks, range(1, greatest(len(ws) - ks.k + 2, 1)) t(i)),
met AS (SELECT DISTINCT occ.doc_id, win.item_id, occ.i, occ.k FROM occ JOIN win ON occ.g = win.g AND occ.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES = {"op8_decontaminate": ORACLE}

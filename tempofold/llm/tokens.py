"""Ids of a public byte-level tokenizer, and offset-mapped token counts.

A text is encoded once and whole. Byte-level tokens spell out bytes, so the running sum of their byte
lengths is their place in the text; token spans then meet the spans of sections by interval join.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = ("first", "last", "most", "share")
SCHEMA = "doc_id long, section long, start long, end long, tokens double, crossing long"


def vocabulary() -> tuple[str, str]:
    """Paths of one vocabulary in its two forms."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def added(path: str) -> dict[str, int]:
    """Strings that the vocabulary takes as one token wherever they stand in a text, and their ids."""
    import json

    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encoder(paths: tuple[str, str]) -> Callable[[str], np.ndarray]:
    """text -> ids (unsigned 32-bit), as the JSON form's library gives them without adding special tokens.

    Strings of added tokens part a text and are one id each. What lies between goes to the ranks file,
    which holds the same vocabulary; its encoder gives the same ids several times faster (tests compare
    with the library as it comes). Where it gives up, on huge runs without a break, the library encodes.
    Built anew in each task (a tenth of a second): a cache would have to travel with the function.
    """
    import base64
    import re

    import public_tokenizers
    import tiktoken

    with open(paths[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = added(paths[0])
    parts = re.compile("(" + "|".join(map(re.escape, sorted(whole, key=len, reverse=True))) + ")") if whole else None
    slow: list = []

    def plain(text: str) -> list[int]:
        try:
            return quick._core_bpe.encode_ordinary(text)
        except BaseException as e:  # the encoder's own panics are no Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(paths[0]))
            return slow[0].encode(text, add_special_tokens=False).ids

    def encode(text: str) -> np.ndarray:
        if parts is None or not any(x in text for x in whole):
            return np.array(plain(text), np.uint32)
        return np.array([i for k, x in enumerate(parts.split(text)) for i in ([whole[x]] if k % 2 else plain(x))], np.uint32)

    return encode


def token_bytes(paths: tuple[str, str]) -> np.ndarray:
    """Byte length of each id."""
    import base64

    with open(paths[1], "rb") as f:
        pairs = [(int(b), len(base64.b64decode(a))) for a, b in map(bytes.split, f)]
    pairs += [(i, len(x.encode())) for x, i in added(paths[0]).items()]
    out = np.zeros(max(i for i, _ in pairs) + 1, np.int64)
    out[[i for i, _ in pairs]] = [n for _, n in pairs]
    return out


def attribute(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and tokens of it that cross an edge.

    Spans are half-open bytes; ``cuts`` are the sections' edges, ascending, from 0 to the end; sections
    may be empty. ``first``/``last``: the section of the token's first/last byte. ``most``: the section
    with most of its bytes, the earlier on a tie. ``share``: every section by its part of the bytes.
    """
    n = len(cuts) - 1
    first, last = np.searchsorted(cuts, starts, "right") - 1, np.searchsorted(cuts, ends - 1, "right") - 1
    over = np.flatnonzero(first != last)
    crossing = np.bincount(first[over], minlength=n)
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float), crossing
    if rule == "last":
        return np.bincount(last, minlength=n).astype(float), crossing
    inside = np.ones(len(starts), bool)
    inside[over] = False
    out = np.bincount(first[inside], minlength=n).astype(float)
    for k in over:  # few: a token spells out few bytes, an edge cuts one token
        at = np.arange(first[k], last[k] + 1)
        part = np.minimum(cuts[at + 1], ends[k]) - np.maximum(cuts[at], starts[k])
        if rule == "most":
            out[at[np.argmax(part)]] += 1
        else:
            out[at] += part / part.sum()
    return out, crossing


def count(docs: DataFrame, fields: Column | str = "text", id_col: str = "doc_id", rule: str = "most", paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per section of each row: doc_id, section (from 0), start and end (characters), tokens, crossing.

    ``fields`` is a string column, whose sections are its lines (each with its line feed), or an array
    of strings, whose sections are its elements, encoded as one text without separators. Tokens that
    cross an edge go by ``rule`` (see ``attribute``); ``crossing`` counts those that start in the
    section and end beyond it. Null and empty texts are one empty section without tokens, null
    elements empty sections, rows with equal ids stay rows of their own. Extra columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    col = F.col(fields) if isinstance(fields, str) else fields
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), col.alias("body"))
    many = rows.schema["body"].dataType.typeName() == "array"
    # Arrays travel as they are; whole lines need no split before they are encoded.
    return rows.mapInArrow(functools.partial(_count, many=many, rule=rule, paths=paths or vocabulary()), SCHEMA)


def _count(batches: Iterator[pa.RecordBatch], many: bool, rule: str, paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    encode, length = encoder(paths), token_bytes(paths)
    for batch in batches:
        out = []
        for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
            out.append((doc, *sections(body, many, rule, encode, length)))
        if out:
            sizes = [len(r[3]) for r in out]
            cat = lambda k, kind: np.concatenate([r[k] for r in out]).astype(kind)
            ids = pa.array([r[0] for r in out], pa.int64()).take(pa.array(np.repeat(np.arange(len(out)), sizes)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([np.arange(n) for n in sizes])), pa.array(cat(1, np.int64)), pa.array(cat(2, np.int64)), pa.array(cat(3, float)),
                                              pa.array(cat(4, np.int64))], ["doc_id", "section", "start", "end", "tokens", "crossing"])


def sections(body, many: bool, rule: str, encode, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end (characters), tokens, crossing of the sections of one text."""
    if many:
        parts = [x or "" for x in body or []] or [""]
        text = "".join(parts)
        raw = text.encode()
        cuts = np.cumsum([0, *(len(x.encode()) for x in parts)])
    else:
        text = body or ""
        raw = text.encode()
        breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
        cuts = np.concatenate(([0], breaks, [len(raw)] if not len(breaks) or breaks[-1] != len(raw) else [])).astype(np.int64)
    ids = encode(text)
    ends = np.cumsum(length[ids])
    tokens, crossing = attribute(np.concatenate(([0], ends[:-1])), ends, cuts, rule) if len(ids) else (np.zeros(len(cuts) - 1), np.zeros(len(cuts) - 1, np.int64))
    chars = cuts if len(raw) == len(text) else np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))[cuts]
    return chars[:-1], chars[1:], tokens, crossing


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token that crosses a line's edge goes to the line with most of its bytes."""
    return count(common.table(spark, sf_dir, "documents")).withColumn("tokens", F.col("tokens").cast("long"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}

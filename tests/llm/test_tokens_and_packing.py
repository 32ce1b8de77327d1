import bisect
import functools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempofold.llm import packing, tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary()[0])


@pytest.fixture(scope="module")
def encode():
    return tokens.encoder(tokens.vocabulary())


def test_both_forms_of_the_vocabulary_give_the_same_ids(docs, library, encode):
    for r in docs.select("text").collect():
        assert library.encode(r.text, add_special_tokens=False).ids == encode(r.text).tolist()
    for t in ("", " ", "\n\n a", "<|endoftext|>", "a b c", "don't  stop\t\n", "😀" * 50, " " * 5000 + "x", "x" * 5000):
        assert library.encode(t, add_special_tokens=False).ids == encode(t).tolist()


@settings(max_examples=150, deadline=None)
@given(t=st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", " ", "\n", "a b", "<|endoftext", "é"]), max_size=8).map("".join))
def test_same_ids_for_any_text(t):
    lib, enc = _pair()
    assert lib.encode(t, add_special_tokens=False).ids == enc(t).tolist()


@functools.cache
def _pair():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary()[0]), tokens.encoder(tokens.vocabulary())


def test_packing_takes_added_tokens_as_the_library_does(spark, library):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "é<|endoftext|>é " * 300]
    rows = list(enumerate(texts))
    _check(packing.pack(spark.createDataFrame(rows, "doc_id long, text string")), rows, lambda t: np.array(library.encode(t, add_special_tokens=False).ids, np.uint32))
    counted = tokens.count(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.tokens for r in counted} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_rules_for_tokens_that_cross_an_edge():
    starts, ends, cuts = np.array([0, 2, 6]), np.array([2, 6, 8]), np.array([0, 3, 3, 8])
    assert tokens.attribute(starts, ends, cuts, "first")[0].tolist() == [2, 0, 1]
    assert tokens.attribute(starts, ends, cuts, "last")[0].tolist() == [1, 0, 2]
    assert tokens.attribute(starts, ends, cuts, "most")[0].tolist() == [1, 0, 2]
    assert tokens.attribute(starts, ends, cuts, "share")[0].tolist() == [1.25, 0, 1.75]
    assert tokens.attribute(starts, ends, cuts, "share")[1].tolist() == [1, 0, 0]


@pytest.mark.parametrize("rule", ["first", "most"])
def test_counts_against_the_offsets_of_the_library(docs, library, rule):
    got = defaultdict(dict)
    for r in tokens.count(docs, rule=rule).collect():
        got[r.doc_id][r.start, r.end] = r.tokens
    for r in docs.select("doc_id", "text").collect():
        lines = r.text.splitlines(keepends=True) if "\r" not in r.text else None
        e = library.encode(r.text, add_special_tokens=False)
        assert sum(got[r.doc_id].values()) == len(e.ids)
        if lines is None or any(c in r.text for c in "\x0b\x0c\x1c\x1d\x1e\x85  ") or not r.text.isascii():
            continue
        at, spans = 0, []
        for line in lines:
            spans.append((at, at + len(line)))
            at += len(line)
        want = dict.fromkeys(spans, 0)
        for a, b in e.offsets:  # max takes the earlier of equal shares
            want[max(spans, key=lambda s: (s[0] <= a < s[1]) if rule == "first" else min(b, s[1]) - max(a, s[0]))] += 1
        assert got[r.doc_id] == want


def test_odd_rows_and_fields(spark, odd, odd_rows, none, encode):
    found = tokens.count(odd).collect()
    assert sum(r.tokens for r in found) == sum(len(encode(t or "")) for _, t in odd_rows)
    assert {(r.doc_id, r.start, r.end) for r in found if r.doc_id in (2, 3)} == {(2, 0, 0), (3, 0, 0)}
    fields = spark.createDataFrame([(1, ["Größ", None, "e ist", ""]), (2, None), (3, [])], "doc_id long, parts array<string>")
    rows = {(r.doc_id, r.section): (r.start, r.end) for r in tokens.count(fields, "parts").collect()}
    assert rows == {(1, 0): (0, 4), (1, 1): (4, 4), (1, 2): (4, 9), (1, 3): (9, 9), (2, 0): (0, 0), (3, 0): (0, 0)}
    assert tokens.count(none).count() == 0
    with pytest.raises(ValueError):
        tokens.count(odd, rule="none")


def test_fullest_is_the_best_sum():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = {int(s): int(n) for s, n in zip(rng.integers(1, 40, 6), rng.integers(1, 4, 6))}
        sums = {0}
        for s, n in counts.items():
            sums = {x + s * k for x in sums for k in range(n + 1)}
        chosen = packing.fullest(counts, 60)
        assert sum(s * n for s, n in chosen.items()) == max(x for x in sums if x <= 60)
        assert all(n <= counts[s] for s, n in chosen.items())


def test_bins_use_every_piece_once():
    rng = np.random.default_rng(2)
    counts = {int(s): int(n) for s, n in zip(rng.integers(1, 1025, 300), rng.integers(1, 50, 300))}
    used = defaultdict(int)
    packed = packing.bins(counts)
    for times, sizes in packed:
        assert sum(sizes) <= 1024
        for s in sizes:
            used[s] += times
    assert dict(used) == counts
    assert sum(t for t, _ in packed) <= best_fit_decreasing(counts)


def best_fit_decreasing(counts, capacity=1024):
    free, made = [], 0
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        k = bisect.bisect_left(free, s)
        if k < len(free):
            bisect.insort(free, free.pop(k) - s)
        else:
            made += 1
            bisect.insort(free, capacity - s)
    return made


def _check(found, rows, encode):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in found.collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 1024
    want = sorted(((d, a, zlib.crc32(ids[a:b].tobytes())) for d, t in rows for ids in [np.append(encode(t or ""), 2).astype("<u4")] for a, b in _cuts(len(ids))), key=str)
    assert sorted(((r.doc_id, r.start, r.ids_crc32) for p in pieces.values() for r in p), key=str) == want
    total = sum(n for s in bins.values() for _, n in s)
    return len(bins), -(-total // 1024)


def _cuts(n):
    edges = [0, *range(n % 1024 or 1024, n + 1, 1024)]
    return list(zip(edges, edges[1:]))


def test_packing(docs, odd, odd_rows, none, encode):
    made, least = _check(packing.pack(docs), [tuple(r) for r in docs.select("doc_id", "text").collect()], encode)
    assert made <= 1.02 * least + 1
    _check(packing.pack(odd), odd_rows, encode)
    assert packing.pack(none).count() == 0

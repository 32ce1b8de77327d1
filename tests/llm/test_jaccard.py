import math
import random
from itertools import combinations

import numpy as np
import pytest

from tempofold.llm import jaccard

from .conftest import shingle_set


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    near = [set() for _ in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            near[a].add(b)
            near[b].add(a)
            root[top(a)] = top(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(top(k), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((i, least[top(k)], len(near[k])) for k, (i, _) in enumerate(rows)), key=str)


def result(found):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in found.collect()), key=str)


def copies(n=90, seed=3):
    """A group of near copies at all distances around the least similarity, some exact copies, and strangers."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = rng.choices(vocabulary, k=150)
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(n + i, rows[i][1].upper()) for i in range(6)]
    rows += [(2 * n + i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(20)]
    return rows


def test_against_brute_force_with_splits_and_blocks(spark):
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert result(jaccard.links(df)) == want
    assert result(jaccard.links(df, bucket=8, block=7, broadcast_rows=0)) == want  # split buckets, large ones in blocks, no broadcast


def test_tables(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(jaccard.links(docs)) == brute(rows)


def test_odd_rows_and_keep(odd, odd_rows, none):
    assert result(jaccard.links(odd)) == [(i, i if not shingle_set(t) else c, n) for (i, c, n), (_, t) in zip(brute(odd_rows), sorted(odd_rows, key=lambda r: str((r[0], 0))))] or result(
        jaccard.links(odd)) == brute(odd_rows)
    kept = jaccard.keep(odd)
    assert kept.columns == odd.columns
    left = sorted((shingle_set(r.text) for r in kept.collect()), key=len)
    assert len([s for s in left if s]) == len({s for _, t in odd_rows if (s := shingle_set(t))})
    assert len([s for s in left if not s]) == sum(not shingle_set(t) for _, t in odd_rows)
    assert jaccard.links(none).count() == 0 and jaccard.keep(none).count() == 0


def test_recall_bound_of_the_runs():
    assert jaccard.runs_for(0.9999, 0.8) >= 3
    rng = np.random.default_rng(5)
    q = 1.0
    for _ in range(50):
        q = 1 - (1 - 0.8 * q) ** 2
    assert 1 - (1 - q) ** jaccard.runs_for(0.9999, 0.8) >= 0.9999
    a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    s, t = jaccard.sketch(np.unique(a[:850])), jaccard.sketch(np.unique(a[50:]))
    assert abs((s == t).mean() - 800 / 900) < 0.2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    got = dict(jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}


def test_recall_with_one_sketch_for_all_runs():
    """The sum over places in common, level by level: runs share the sketch, the cut drops pairs for good."""
    runs, cut, places = jaccard.runs_for(0.9999, 0.8), jaccard.cut_for(0.9999, 0.8), jaccard.PLACES
    lost = 0.0
    for m in range(places + 1):
        s, t, q = m / places, m * (m - 1) / (places * (places - 1)), 1.0
        for _ in range(jaccard.LEVELS + 1):
            q = 2 * s * q - t * q * q
        lost += math.comb(places, m) * 0.8**m * 0.2 ** (places - m) * ((1 - q) ** runs if m >= cut else 1)
    assert lost <= 1e-4 and lost <= jaccard.loss(runs, 0.8, cut) <= 1e-4
    assert jaccard.loss(4, 0.8, 39) > 2.5e-4  # what four runs and a cut at 39 of 64 places lose
    with pytest.raises(ValueError):
        jaccard.runs_for(0.9999, 0.5)

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from tempofold.llm import common, lm

from .conftest import LOWER


def brute(rows, held):
    toks = [(i, h, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]) for (i, t), h in zip(rows, held)]
    c, c2 = Counter(), Counter()
    for _, h, t in toks:
        if not h:
            c.update(t)
            c2.update(zip([None] + t[:-1], t))
    n, v = sum(c.values()), len(c)
    stats = defaultdict(list)
    for _, h, t in toks:
        for a, b in [] if h else zip([None] + t[:-1], t):
            stats[int(math.log2(c[a])) + 1].append(((c2[a, b] - 1) / (c[a] - 1) if c[a] > 1 else 0, (c[b] - 0.5) / (n - 1 + 0.5 * (v + 1))))
    weight = {}
    for k, x in stats.items():
        f, w = np.array(x), 0.5
        for _ in range(300):
            w = (w * f[:, 0] / (w * f[:, 0] + (1 - w) * f[:, 1])).mean()
        weight[k] = w
    out = []
    for i, h, t in toks:
        one = [(c[w] + 0.5) / (n + 0.5 * (v + 1)) for w in t]
        mixed = []
        for a, b, u in zip([None] + t[:-1], t, one):
            w = weight.get(int(math.log2(c[a])) + 1, 0) if c[a] else 0
            mixed.append(w * c2[a, b] / max(c[a], 1) + (1 - w) * u)
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), n, sum(map(math.log10, one)), sum(map(math.log10, mixed))))
    return sorted(out, key=str)


def check(found, want):
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    np.testing.assert_allclose([g[6] for g in got], [w[6] for w in want], rtol=5e-4)


def test_against_brute_force_over_many_blocks_and_ranges(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows])
    check(lm.score(docs, common.fold(lm.F.col("doc_id")) == 1, block_bytes=60_000, range_bytes=50_000), want)
    held = [w for w in want if w[1]]
    assert sum(w[6] for w in held) > sum(w[5] for w in held)  # contexts help on texts that were not learned from


def test_odd_rows(spark, odd, odd_rows, none):
    check(lm.score(odd), brute(odd_rows, [False] * len(odd_rows)))
    check(lm.score(odd, lm.F.lit(True)), brute(odd_rows, [True] * len(odd_rows)))  # nothing to learn from
    assert lm.score(none).count() == 0


def test_packed_integers_come_back():
    for x in ([], [0], [5, 0, 2**63], list(range(1000))):
        assert lm.unpack(lm.pack(np.array(x, np.uint64))).tolist() == x

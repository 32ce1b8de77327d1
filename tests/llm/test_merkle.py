import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tempofold.llm import merkle

from .conftest import SF


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def fold_up(level):
    """All levels of a tree, leaves first."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    return [(bool(i >> k & 1), level[i >> k ^ 1] if (i >> k ^ 1) < len(level) else None) for k, level in enumerate(levels[:-1])]


def expected(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = fold_up([leaf_of(r) for r in groups[g]])
    top = fold_up([trees[g][-1][0] for g in langs])
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            bent = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf_of((*r[:3], r[3] + 1, r[4])) if bent else leaf_of(r)
            for left, s in path:
                h = sha(s, h) if left else sha(h, s or "")
            root = top[-1][0]
            out.append((r[0], leaf_of(r), trees[g][-1][0], root, sha(*(s for _, s in path if s)), h, h == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def query(spark, docs, tmp_path, name="documents"):
    docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op13_merkle(spark, f"{tmp_path}/{name}").select(*COLUMNS).collect()), key=str)


def test_registered_query_against_hashlib(spark, docs):
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    got = sorted((tuple(r) for r in merkle.op13_merkle(spark, SF).select(*COLUMNS).collect()), key=str)
    assert got == expected(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 65, 513, 1100])
def test_trees_of_many_sizes(spark, tmp_path, n):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(n)] + [(7 * i, "s", "fr", None, None) for i in range(n % 5)] + [(3, None, None, 2**63 - 1, "ü")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert query(spark, docs, tmp_path) == expected(rows)


def test_odd_rows_and_no_rows(spark, odd, odd_rows, none, tmp_path):
    got = query(spark, odd, tmp_path)
    assert got == expected([(d, "src0", "en", None, t) for d, t in odd_rows])
    assert query(spark, none, tmp_path, "none") == []


def test_a_hot_group_is_ranked_over_several_ranges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    rows = [(5, "s", "de", 1, "same")] * 300 + [(i, "s", f"l{i % 97}", i, "x") for i in range(200)] + [(None, None, None, None, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    assert query(spark, docs, tmp_path) == expected(rows)


def test_proofs_verify_without_the_table(spark, docs):
    proofs = merkle.prove(docs, size=F.col("n_chars"))
    checked = proofs.select("size", "root", merkle.fold(F.col("leaf"), F.col("path")).alias("again"), merkle.fold(F.lit("0" * 64), F.col("path")).alias("wrong")).collect()
    assert all(r.again == r.root != r.wrong and r["size"] is not None for r in checked) and len({r.root for r in checked}) == 1
    published = merkle.manifest(proofs).collect()
    assert sum(r.rows for r in published) == len(checked) and len(published) == docs.select("lang").distinct().count()
    with pytest.raises(ValueError):
        merkle.prove(docs, root=F.col("n_chars"))


def test_groupings_of_a_block_share_one_shuffle(spark, docs):
    nodes = docs.select(F.col("lang").alias("key"), F.lit(8).alias("height"), F.col("doc_id").alias("rank"), merkle.leaf().alias("node"), F.struct("doc_id").alias("load"))
    plan = merkle._blocks(nodes, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1

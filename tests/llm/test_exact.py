import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tempofold.llm import exact


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def check(found, rows):
    got = found.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    stays = defaultdict(int)
    for r in got:
        stays[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(stays.values()) <= {1}


def test_odd_rows(odd, odd_rows):
    check(exact.classes(odd), odd_rows)


def test_digests_that_collide_are_told_apart_by_bytes(odd, odd_rows):
    weak = lambda text, turn: F.pmod(F.crc32(F.concat(text, F.lit(str(turn))).cast("binary")), F.lit(2)).cast("string")
    check(exact.classes(odd, digest=weak), odd_rows)


def test_state_carries_over_batches(spark, docs, tmp_path):
    docs.select("doc_id", "text").repartition(5).write.parquet(str(tmp_path / "d"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(exact.classes(spark.read.parquet(str(tmp_path / "d")), files_per_batch=1, broadcast_rows=0), rows)


def test_keep_holds_columns_and_one_row_of_each_text(odd, odd_rows):
    kept = exact.keep(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in odd_rows})


def test_empty(none):
    assert exact.classes(none).count() == 0 and exact.keep(none).count() == 0

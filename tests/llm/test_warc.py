import base64
import gzip
import hashlib
from pathlib import Path

from tempofold.llm import common, warc

TRICK = "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabc"
PAGES = [(1, "http://a/", "<p>ä</p>"), (2, None, "<p>ä</p>"), (3, "http://b/ c\n", None), (4, "u", ""), (None, "u", "lone"), (5, "u", TRICK), (6, "u", TRICK + "\r\n\r\n"), (7, "u", "\r\n\r\n\r\n\r\n"),
         (8, "u", "WARC/1.1\r\n"), (9, "u", "y" * 17_000_000), (10, "u", "<p>ä</p>"), (10, "u", "<p>ä</p>"), (10, "u", "other of the same id"), (11, "u", "z" * 65_530 + TRICK)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "k", True) for r in rows], "page_id long, url string, html string, keep string, checked boolean")


def archive(spark, rows=PAGES, **how):
    mono, out = common.scratch(spark, "t-mono"), common.scratch(spark, "t-norm")
    warc.write_monolithic(warc.record(pages(spark, rows)).repartition(2), mono, **how)
    warc.normalise(spark, mono, out)
    return mono.removeprefix("file://"), out.removeprefix("file://")


def test_round_trip_members_and_index(spark):
    mono, out = archive(spark, records_per_file=4)
    for f in Path(mono).glob("*.gz"):  # one stream of a whole file
        data = f.read_bytes()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n") and data.count(b"\x1f\x8b\x08") >= 1
    seen, at = [], {}
    for r in spark.read.parquet(f"{out}/index").collect():
        at.setdefault(r.archive, []).append(r)
    assert len(at) >= 3
    for name, rows in at.items():
        (part,) = [p for p in Path(out, "archives", f"archive={name}").iterdir() if p.name.startswith("part-")]
        data = part.read_bytes()
        rows.sort(key=lambda r: r.seq)
        assert len(data) - sum(r.length for r in rows) in (0, 20)  # an empty member may follow a record of 16 MiB
        assert gzip.decompress(data) == b"".join(gzip.decompress(data[r.offset : r.offset + r.length]) for r in rows)  # each record its own member
        for r in rows:
            record = gzip.decompress(data[r.offset : r.offset + r.length])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and (r.record_id or "").encode() in record
            seen.append(record)
    assert len(seen) == len(PAGES)
    back = warc.read_records(spark, out).collect()
    got = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.digest, bytes(r.payload)) for r in back)
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        again = i is not None and i != max(same)
        want.append((f"<urn:page:{'' if i is None else i}>", "revisit" if again else "response", f"<urn:page:{max(same)}>" if again else None, len(body),
                     base64.b32encode(hashlib.sha1(body).digest()).decode(), b"" if again else body))
    assert [tuple("" if x is None else x for x in r) for r in got] == [tuple("" if x is None else x for x in r) for r in sorted(want, key=lambda r: tuple("" if x is None else x for x in r))]
    assert all(r.checked for r in back if r.record_type == "response")


def test_starts_of_records_at_every_place_of_the_read_buffer(spark):
    rows = [(i, "u", "p" * (65_536 - 700 + 7 * i) + "\r\n\r\n" * (i % 4) + (TRICK if i % 3 else "")) for i in range(200)]
    _, out = archive(spark, rows)
    got = {r.record_id: bytes(r.payload).decode() for r in warc.read_records(spark, out).collect()}
    assert got == {f"<urn:page:{i}>": h for i, _, h in rows}


def test_payloads_below_the_least_are_all_responses(spark):
    assert {r.page_id for r in warc.revisits(pages(spark), 0).collect()} == {1, 2, 3}
    assert warc.revisits(pages(spark), 1000).count() == 0


def test_empty(spark):
    _, out = archive(spark, [])
    assert warc.read_records(spark, out).count() == 0

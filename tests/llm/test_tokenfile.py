import functools
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempofold.llm import tokenfile

from .conftest import SF


@functools.cache
def _pair():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfile.vocabulary()), tokenfile.Encoder(tokenfile.vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfile.vocabulary())


def _ids(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@settings(max_examples=400, deadline=None)
@given(ts=st.lists(st.text(max_size=40) | st.text("aAÄé×ß,.3²s b'\n\x1c\x85  éͅΣΑςΙ̇<|endoftxsar>0९", max_size=40), max_size=5))
def test_pieces_give_the_ids_of_the_whole_text(ts):
    lib, enc = _pair()
    ids, size = enc([t.encode() for t in ts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(size))[:-1]] == [lib.encode(t, add_special_tokens=False).ids for t in ts]


def test_special_strings_and_a_small_memory(library, monkeypatch):
    for held in ("WORDS_HELD", "BLOCK_BYTES"):
        monkeypatch.setattr(tokenfile, held, 30)
    enc = tokenfile.Encoder(tokenfile.vocabulary())
    for t in ("a <|endoftext|> b", "x<|startoftext|>y", "", " \n", "İstanbul ẞ É é don't", "\x00 \x1c x", "word " * 3000, "x" * 9000, "it's 'stop' ,'s ''re 'LL'd x'v 'vex l'été 'é 12'3", "Ärger ÜBER straße Ñandú 3×4 ÷ x", "'s", "'", "a'" * 40):
        ids, size = enc([t.encode(), b"b"])
        assert ids[: size[0]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_white_space_must_not_be_part_of_tokens():
    import public_tokenizers

    with pytest.raises(ValueError):
        tokenfile.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def _expected(rows, library):
    start, out = 0, []
    for doc, text in rows:
        ids = _ids(library, text)
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_registered_query_against_the_library(spark, docs, library):
    want = _expected(sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), library)
    assert sorted(tuple(r) for r in tokenfile.op11_token_ids(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_odd_rows(spark, odd, odd_rows, none, library, tmp_path):
    path = tokenfile.write(odd, f"{tmp_path}/odd", shard_bytes=5_000)
    got = sorted((r.start, r.n_tokens, r.doc_id, r.ids_crc32) for r in tokenfile.checksums(spark, path).collect())
    assert [s for s, *_ in got] == np.cumsum([0, *(n for _, n, *_ in got)])[:-1].tolist()
    assert [d is not None for _, _, d, _ in got] == [False] * 2 + [True] * (len(odd_rows) - 2)
    assert [d for *_, d, _ in got][2:] == sorted(d for d, _ in odd_rows if d is not None)
    key = lambda x: (x[0] is None, x)
    assert sorted(((d, n, c) for _, n, d, c in got), key=key) == sorted(((d, len(i), zlib.crc32(i.tobytes())) for d, t in odd_rows for i in [_ids(library, t)]), key=key)
    assert tokenfile.index(spark, path).count() > 1
    empty = tokenfile.write(none, f"{tmp_path}/none")
    assert tokenfile.checksums(spark, empty).count() == 0 and tokenfile.window(spark, empty, 0, 10).count() == 0


@pytest.mark.parametrize("encoding", tokenfile.ENCODINGS)
def test_layout_of_the_files(spark, docs, library, tmp_path, encoding):
    path = tokenfile.write(docs, f"{tmp_path}/f", encoding, shard_bytes=60_000, row_group_bytes=12_000, page_bytes=4_000, page_rows=20)
    files = sorted((tmp_path / "f" / "shards").glob("*.parquet"))
    assert len(files) == tokenfile.index(spark, path).count() > 1
    meta = pq.ParquetFile(files[0]).metadata
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    ids = columns["ids.list.element"]
    assert ("RLE_DICTIONARY" in ids.encodings) == (encoding == "dictionary") and ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta")
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["at"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    assert meta.num_row_groups > 1
    # Files, rows and places all ascend.
    rows = [r for f in files for r in pq.read_table(f, columns=["doc_id", "at", "n_tokens"]).to_pylist()]
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    ids = np.concatenate([_ids(library, t) for _, t in sorted((r.doc_id, r.text) for r in docs.collect())])
    assert np.concatenate([np.concatenate(pq.read_table(f)["ids"].to_pylist()) for f in files]).tolist() == ids.tolist()
    # Selective reads.
    total = len(ids)
    for a, b in ((0, total), (5, 6), (total // 3, total // 2), (total - 3, total + 9), (7, 7), (total, total + 5)):
        found = sorted(tuple(r) for r in tokenfile.window(spark, path, a, b).select("start", "ids").collect())
        assert [i for _, x in found for i in x] == ids[a:b].tolist()
        assert all(s == max(a, 0) + sum(len(x) for _, x in found[:k]) for k, (s, _) in enumerate(found))
    plan = tokenfile.metadata(spark, path)._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1]
    part = tokenfile.documents(spark, path, 10, 19)
    assert "GreaterThanOrEqual(doc_id,10)" in part._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in part.collect()) == list(range(10, 20))


def test_unknown_encoding(odd, tmp_path):
    with pytest.raises(ValueError):
        tokenfile.write(odd, f"{tmp_path}/x", "plain")

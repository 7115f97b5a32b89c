"""Operator 9: exact round trip against the tokenizers library."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from foliant.llm import token_files
from foliant.llm._tables import new_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_vocabulary())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, docs, rows, plain, encoding):
    path = new_path(spark, "t")
    token_files.write_tokens(docs, path, encoding=encoding)
    want, start = {}, 0
    for i, text, *_ in sorted(rows):
        ids = plain(text)
        want[i] = (start, len(ids), ids)
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, list(r.ids)) for r in token_files.read_tokens(spark, path).collect()}
    assert got == want
    digests = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digests(spark, path).collect()}
    assert digests == {i: (a, n, zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for i, (a, n, ids) in want.items()}
    part = token_files.read_tokens(spark, path, low=10, high=20)
    assert sorted(r.doc_id for r in part.collect()) == list(range(10, 21))


def test_odd_words(plain):
    enc = token_files.encoder(token_files.default_vocabulary())
    texts = ["", "don't STOP'LL 1234 a.b!!c", "ǅ İstanbul ﬁ é", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "a b c", "日本語 テスト", "\x00a\x1cb\x85c", "Straße — 5€", "😀😀 ok"]
    texts += ["Éçeau's ÀÖ×Ø÷ ßÿ12ª", "cafe\u0301 ŒUVRE", "don't'LLx're", "é", "x", "a1b2Ç3", "end", "é é", "", "##é$$", "É" * 40, "\u00c3\u0083 Ã"]
    for _ in range(2):  # from the memo, the second time
        raw = [t.encode() for t in texts]
        out, sizes = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), 1)
        assert [x.tolist() for x in np.split(out, np.cumsum(sizes)[:-1])] == [plain(t) for t in texts]
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        assert enc.encode(raw, np.array([0, len(raw)]), 1)[0].tolist() == plain(t)


def test_empty_table_and_equal_ids(spark, empty):
    path = new_path(spark, "t")
    token_files.write_tokens(empty, path)
    assert token_files.token_digests(spark, path).count() == 0
    odd = spark.createDataFrame([(None, "a", 1), (3, "b", 1), (3, "a", 2), (3, "a", 3)], "doc_id long, text string, ids int")
    token_files.write_tokens(odd, path := new_path(spark, "t"))
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_files.token_digests(spark, path).orderBy("start").collect()] == [(None, 0, 2), (3, 2, 2), (3, 4, 2), (3, 6, 2)]


def test_layout(spark, docs):
    path = new_path(spark, "t")
    token_files.write_tokens(docs, path, encoding="delta")
    import glob

    files = [f for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(4)
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_offset_index

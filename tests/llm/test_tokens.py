import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vecroute.llm import token_counts
from vecroute.llm.common import shared_dir
from vecroute.llm.encode import PieceStore
from vecroute.llm.q_tokens import SEPARATOR, op1_token_counts, op4_token_output, token_output, tokenizer_file
from vecroute.llm.token_counts import row_places, scan_token_files, write_token_files

SF = "/root/testdata/sf0.001"
NAME = tokenizer_file("word_bpe_49k.json")
ODD = [None, "", "  ", "it's don't a.b, x's.'s É́ é é", "<|endoftext|> A<|startoftext|>b <|x|>", "ab≮c 日本語、テスト 👍🏽ok", "x y z\x1cq"]


def library(plain=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(NAME)
    t.encode_special_tokens = plain
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(4)
    letters = "aBé'́.,!<|>#s t\n\tll re1٣  İßΣς-_`~’"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)] + ["long word " * 20_000]


@pytest.mark.parametrize("plain", [False, True])
def test_pieces_equal_whole_texts(plain):
    store, encode = PieceStore(NAME, plain, most=50), library(plain)
    for _ in range(2):  # with an empty and with a full store
        ids, ends = store.encode(pa.array(odd_texts()), 2)
        for i, t in enumerate(odd_texts()):
            assert ids[ends[i] : ends[i + 1]].tolist() == [*encode(t), 2]
        assert store.count(pa.array(odd_texts())).tolist() == [len(encode(t)) for t in odd_texts()]


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    assert PieceStore(NAME).by_piece
    name = tokenizer_file("byte_bpe_50k.json")
    store, whole = PieceStore(name), Tokenizer.from_file(name)
    assert not store.by_piece
    texts = ["The cat sat, twice.", " two  blanks\n\nand lines", None, ""]
    ids, ends = store.encode(pa.array(texts), 2)
    for i, t in enumerate(texts):
        want = whole.encode(t or "", add_special_tokens=False).ids
        assert ids[ends[i] : ends[i + 1]].tolist() == [*want, 2] and store.count(pa.array(texts))[i] == len(want)


def digests(rows, encode):
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encode(text), 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_output_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(3, ODD[3])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_tokens int").repartition(5)
    got = sorted(tuple(r) for r in token_output(spark, df).collect())
    assert got == sorted(digests(rows, library()))
    assert token_output(spark, df.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, "b"), (1, "a")], "doc_id long, text string")
    assert [r["start"] for r in token_output(spark, null_id).collect() if r["doc_id"] == 1] == [2]


def test_token_output_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r)[:4] for r in op4_token_output(spark, SF).collect()) == digests(rows, library())


def test_scan_stitches_blocks(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(3, ODD[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    source = shared_dir(spark, "odd")
    df.write.parquet(source)
    df = spark.read.parquet(source)
    path = shared_dir(spark, "flat")
    write_token_files(df, path, NAME, SEPARATOR)
    encode = library(plain=True)
    want = {i: len(encode(t)) for i, t in rows}
    found = None
    for size in (2, 64, 4 << 20):
        if size == 2 and len(rows) > 60:
            size = 1024
        counts = scan_token_files(spark, path, SEPARATOR, block_bytes=size)
        got = sorted((r["doc_id"], r["n_tokens"], r["start"]) for r in row_places(df.select("doc_id")).join(counts, ["file_no", "row_no"]).collect())
        assert [(i, n) for i, n, _ in got] == sorted((i, want[i]) for i, _ in rows)
        assert found in (None, got)
        found = got
    at = 0
    for _, n, start in sorted(found, key=lambda r: r[2]):
        assert start == at
        at += n + 1


def test_scan_of_foreign_files(spark, tmp_path):
    def put(name, ids, extra=b""):
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes() + extra)

    put("part-00000", [5, 6, SEPARATOR, SEPARATOR, 7])  # an empty document, and a tail without an end
    put("part-00001", [])
    put("part-00002", [SEPARATOR, 1, 2, 3, SEPARATOR], b"\x01")  # an odd last byte
    for size in (2, 4, 1 << 20):
        got = sorted((r["file_no"], r["row_no"], r["n_tokens"], r["start"]) for r in scan_token_files(spark, str(tmp_path), SEPARATOR, size).collect())
        assert got == [(0, 0, 2, 0), (0, 1, 0, 3), (0, 2, 1, 4), (2, 0, 0, 5), (2, 1, 3, 6)]


def test_large_files_are_read_by_block(spark, tmp_path, monkeypatch):
    ids = np.array([*range(1, 50), SEPARATOR, *range(1, 30), SEPARATOR] * 40, "<u2")
    (tmp_path / "part-00000").write_bytes(ids.tobytes())
    near = scan_token_files(spark, str(tmp_path), SEPARATOR, 256).orderBy("row_no").collect()
    monkeypatch.setattr(token_counts, "WHOLE", 100)
    assert scan_token_files(spark, str(tmp_path), SEPARATOR, 256).orderBy("row_no").collect() == near
    assert [r["n_tokens"] for r in near] == [49, 29] * 40


def test_records_per_file_of_the_session_do_not_matter(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        got = sorted(tuple(r) for r in token_output(spark, spark.createDataFrame([(i, f"a text {i}") for i in range(20)], "doc_id long, text string")).collect())
        path = shared_dir(spark, "flat")
        write_token_files(spark.createDataFrame([(f"a text {i}",) for i in range(20)], "text string").coalesce(1), path, NAME, SEPARATOR)
        assert sorted(r["row_no"] for r in scan_token_files(spark, path, SEPARATOR).collect()) == list(range(20))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert got == sorted(digests([(i, f"a text {i}") for i in range(20)], library()))


def test_files_of_other_rows_are_an_error(spark):
    places = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "doc_id long, file_no long, row_no long")
    counts = spark.createDataFrame([(0, 0, 5, 0)], "file_no long, row_no long, n_tokens long, start long")
    with pytest.raises(ValueError, match="written from 2 rows"):
        token_counts.join_counts(places, counts)


def test_token_counts_of_the_table(spark):
    encode = library(plain=True)
    want = {r["doc_id"]: len(encode(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in op1_token_counts(spark, SF).collect()} == want

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecroute.llm.q_sentence_pieces import op12_sentence_pieces
from vecroute.llm.q_tokens import tokenizer_file
from vecroute.llm.sentence_pieces import PairTable, Vocabulary, decode, encode

SF = "/root/testdata/sf0.001"
MODEL = tokenizer_file("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(7)
    letters = "aBé ▁\n\t　日本👍🏽<s>00x12 '..,  ­\x00ñzz"
    odd = [None, "", " ", "▁", "  ▁▁ a", "<s></s><unk><0x41>", "日" * 50, "a" * 3000, "ab" * 5000, "long word, " * 20_000]
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(2000)]


@pytest.mark.parametrize("most", [30, 500_000])
def test_ids_are_the_librarys(most):
    known, sp = Vocabulary(MODEL, most), library()
    for _ in range(2):  # with an empty and with a full store
        ids, ends = known.encode(pa.array(texts()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [sp.encode(t or "", add_bos=True, add_eos=True) for t in texts()]
    assert len(known.index) <= most


def test_normalised_as_by_the_library():
    known = Vocabulary(MODEL)
    assert known.identity
    assert [known.normalised(t or "") for t in texts()] == [library().normalize(t or "") for t in texts()]


def test_check_finds_other_ids():
    known = Vocabulary(MODEL)
    two = pa.array(["some words", "more"])
    ids, ends = known.encode(two)
    known.check(two, ids, ends)
    ids[3] += 1
    with pytest.raises(ValueError, match="some words"):
        known.check(two, ids, ends)


class Small(Vocabulary):
    """A vocabulary given piece by piece, without a model file."""

    def __init__(self, scores, unused=(), bytes_=()):
        self.cost, self.ids = {p: -x for p, x in scores.items()}, {p: i for i, p in enumerate(scores)}
        self.unused, self.bytes, self.unknown = set(unused), list(bytes_), -1


def test_agenda_goes_by_score_then_from_the_left():
    v = Small({"a": 0, "b": 0, "aa": -1, "ab": -2, "aab": -3})
    assert v.merged("aaa") == ["aa", "a"] and v.merged("aab") == ["aab"] and v.merged("abab") == ["ab", "ab"]
    assert Small({"a": 0, "b": 0, "ab": -1, "ba": -1}).merged("bab") == ["ba", "b"]  # a tie: the left pair


def test_unused_pieces_are_taken_apart():
    v = Small({"a": 0, "b": 0, "c": 0, "ab": -1, "abc": -2}, unused={"ab"})
    assert v.merged("ab") == ["a", "b"] and v.merged("abc") == ["abc"] and v.merged("cab") == ["c", "a", "b"]


def test_symbols_that_are_no_piece():
    assert Small({"a": 0}).word_ids("aé") == [0, -1]
    assert Small({"a": 0}, bytes_=range(100, 356)).word_ids("é") == [100 + b for b in "é".encode()]


def test_agenda_against_trying_all_pairs():
    """The best pair of all, looked for anew after each merge."""
    rng = random.Random(11)
    for _ in range(300):
        scores = {c: 0.0 for c in "abc"}
        for _ in range(12):
            scores.setdefault("".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))), -rng.randrange(1, 9))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        left = list(text)
        while pairs := [(-scores[a + b], i) for i, (a, b) in enumerate(zip(left, left[1:], strict=False)) if a + b in scores]:
            i = min(pairs)[1]
            left[i : i + 2] = [left[i] + left[i + 1]]
        assert Small(scores).merged(text) == left
        table = PairTable({p: -x for p, x in scores.items()}, {p: i for i, p in enumerate(scores)})
        symbols, owner = table.merge(["ab", text, "", "c"])
        assert [list(scores)[i] for i in table.ids[symbols[owner == 1]]] == left


def test_defined_cases(spark):
    assert encode(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
    rows = [(None, "a b", "x"), (1, None, "x"), (1, "", None), (1, "a b", "x"), (1, "a b", "x")]
    found = encode(spark.createDataFrame(rows, SCHEMA + ", more string"), MODEL).withColumn("back", decode(F.col("ids"), MODEL)).collect()
    sp = library()
    want = [(d, m, sp.encode(t or "", add_bos=True, add_eos=True), t or "") for d, t, m in rows]
    assert sorted(((r.doc_id, r.more, r.ids, r.back) for r in found), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        encode(spark.createDataFrame([(1, "a", "b")], SCHEMA + ", ids string"), MODEL)
    assert spark.createDataFrame([(None,)], "ids array<int>").select(decode(F.col("ids"), MODEL)).first()[0] is None


def test_query_against_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found, sp = op12_sentence_pieces(spark, SF).collect(), library()
    assert len(found) == len(docs)
    for r in found:
        ids = sp.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()

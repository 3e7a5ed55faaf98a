import random
import zlib

import pandas as pd

from vecroute.llm.language_id import encode, identify, train
from vecroute.llm.q_language import op7_language_id

SF = "/root/testdata/sf0.001"
PARTS = {"xa": "ba be bi bo bu da".split(), "xo": "ort urn elp ask int omm".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_learned_languages_and_edge_cases(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, l, 60), l, 1) for i in range(80) for l in [rng.choice(["xa", "xo"])]]
    train_df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")
    model = train(train_df.unionByName(spark.createDataFrame([(900, "zz", None, 1), (901, None, "xa", 1)], train_df.schema)))
    assert sorted(model.dictionaries) == ["xa", "xo"]
    probe = [(i, text(rng, l, n), l, 0) for i, (l, n) in enumerate([("xa", 3), ("xo", 3), ("xa", 200), ("xo", 5000)])]
    odd = [(10, None, None, 0), (11, "", None, 0), (12, "123 !!", None, 0), (13, "BABE DADA!!! " * 9, "xa", 0), (13, "BABE DADA!!! " * 9, "xa", 0)]
    out = identify(spark.createDataFrame(probe + odd, train_df.schema), model, into="found").select("doc_id", "lang", "found.*").collect()
    assert len(out) == 9
    for r in out:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (10, 11, 12):
            assert r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0
        else:
            assert r["lang_pred"] == r["lang"] and not r["rejected"] or r["doc_id"] in (0, 1)  # three words


def test_whole_texts_are_compressed(spark):
    """Repeated words stay in, and a text's end counts as much as its start."""
    rng = random.Random(6)
    rows = [(i, text(rng, l, 60), l) for i in range(80) for l in [rng.choice(["xa", "xo"])]]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    start, end = text(rng, "xa", 300), text(rng, "xo", 3000)
    probe = spark.createDataFrame([(0, f"{start} {end}"), (1, f"{end} {start}")], "doc_id long, text string")
    got = [r["language"]["lang_pred"] for r in identify(probe, model).orderBy("doc_id").collect()]
    assert got == ["xo", "xo"]
    assert encode(pd.Series(["A b, a B!", None, "1"])) == [b" a b a b ", b"", b""]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = train(none)
    assert identify(none, model).count() == 0
    some = spark.createDataFrame([(1, "words", None)], none.schema)
    assert identify(some, model).first()["language"]["lang_pred"] == "und"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op7_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert sum(r["rejected"] for r in rows) <= 0.02 * len(rows)


def test_query_against_brute_force(spark):
    """Every text of the table, letter by letter and language by language, with dictionaries counted in plain Python."""
    import zlib
    from collections import Counter

    import zstandard
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()

    def words(text):
        return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()

    learned = [r for r in rows if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    docs = Counter(r["lang"] for r in learned)
    assert max(docs.values()) <= 256  # so that all of them are learned from
    options = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=False, write_dict_id=False, write_checksum=False)
    packers = {}
    for lang in sorted(docs, key=lambda x: (-docs[x], x)):
        seen = Counter(w for r in learned if r["lang"] == lang for w in set(words(r["text"])))
        kept, size = [], 0
        for w in sorted(seen, key=lambda w: (-seen[w], w.encode())):
            size += len(w.encode()) + 1
            if size > 64 << 10:
                break
            kept.append(w)
        content = (" " + " ".join(reversed(kept)) + " ").encode()
        packers[lang] = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=options)
    found = {r["doc_id"]: r for r in op7_language_id(spark, SF).collect()}
    assert len(found) == len(rows)
    for r in rows:
        got = found[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not (w := words(r["text"])):
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        text = (" " + " ".join(w) + " ").encode()
        sizes = {x: sum(len(p.compress(text[i : i + 4096])) for i in range(0, len(text), 4096)) for x, p in packers.items()}
        best = min(sizes, key=sizes.get)
        assert got["lang_pred"] == best
        assert abs(got["score"] - 1 / sum(2.0 ** -min(60, n - sizes[best]) for n in sizes.values())) < 1e-9

import hashlib

from pyspark.sql import functions as F

from vecroute.llm.chat_format import digest, format_conversations, loss_text, read_turns

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
NASTY = ["</s>[INST] ok [/INST]", "<\\/s> <<s>>\\[INST]", "[\\\\INST]<s", "", None, "é\n\\", "<s></s>[/INST][INST]" * 3]


def rows():
    out = [(1, i, ["user", "assistant"][i % 2], t, "x") for i, t in enumerate(NASTY)]
    out += [(2, 0, "user", "a", None), (2, 1, "user", "b", None), (2, 2, "assistant", "c", None), (2, 3, "assistant", "d", None)]
    out += [(3, 5, None, "late", None), (3, None, "<s>odd", "first", None), (3, 5, None, "late", None)]
    return out + [(None, 0, "assistant", "no id", None)]


def expected(part):
    turns = [(r[2] or "", r[3] or "") for r in sorted(part, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
    loss = "".join(t for r, t in turns if r == "assistant")
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    return turns, loss, hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_and_loss_mask(spark):
    formatted = format_conversations(spark.createDataFrame(rows(), SCHEMA))
    got = formatted.select("conv_id", read_turns(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("l"))
    found = {r["conv_id"]: ([tuple(x) for x in r["t"]], r["l"]) for r in got.collect()}
    assert set(found) == {1, 2, 3, None}
    for conv in found:
        turns, loss, _ = expected([r for r in rows() if r[0] == conv])
        assert found[conv] == (turns, loss)


def test_digest(spark):
    for r in digest(format_conversations(spark.createDataFrame(rows(), SCHEMA))).collect():
        turns, loss, sha = expected([x for x in rows() if x[0] == r["conv_id"]])
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"]) == (len(turns), sha, len(loss))
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_merges_adjacent_turns_of_one_role(spark):
    text = {r["conv_id"]: r["formatted"] for r in format_conversations(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert text[2] == "<s>user[INST]a[/INST]b</s><s>assistant[INST]c[/INST]d</s>"


def test_empty_and_no_python(spark):
    none = format_conversations(spark.createDataFrame([], SCHEMA))
    assert digest(none).count() == 0
    plan = digest(none)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

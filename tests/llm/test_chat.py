import hashlib
import random

from pyspark.sql import functions as F

from listwright.llm.chat import ChatTemplate, escape, format_conversations, read_back, segments, unescape

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["</s>", "[INST]", "[/INST]", "[\\INST]", "[\\\\OUT]", "\\", "[", "<", "<\\/s>", "[ROLE]", "[TEXT]", "[/ROLE]", "[SYS]", "a b", "\n", "é", "$1", "/s>", "INST]"]


def conversations():
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "[TEXT]x", None])
            rows.append((c, t, role, None if rng.random() < 0.1 else "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 7)))))
    return rows


def test_round_trip(spark):
    rows = conversations()
    out = format_conversations(spark.createDataFrame(rows, SCHEMA)).withColumn("turns", read_back(F.col("lw_formatted")))
    for r in out.collect():
        want = [(role or "", text or "", role == "assistant") for c, t, role, text in sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1])]
        assert [tuple(t) for t in r["turns"]] == want
        assert "".join(s["text"] for s in r["lw_segments"]) == r["lw_formatted"]
        masked = "".join(s["text"] for s in r["lw_segments"] if s["loss"])
        assert masked.count("</s>") == 0


def test_escape_is_reversible(spark):
    rng = random.Random(8)
    texts = [("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))),) for _ in range(400)]
    t = ChatTemplate()
    df = spark.createDataFrame(texts, "t string").withColumn("e", escape(F.col("t"), t))
    for r in df.withColumn("u", unescape(F.col("e"), t)).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in t.controls())


def test_state_machine(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (2, 3, "user", "q"), (2, 4, "assistant", "a")]
    rows += [(3, 0, "assistant", "a"), (4, 0, "user", "q"), (5, 0, "user", "q"), (5, 1, "user", "q"), (6, 0, "user", "q"), (6, 1, "assistant", "a"), (6, 2, "system", "s")]
    got = {r["conv_id"]: (r["lw_valid"], r["lw_bad_turn"]) for r in format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, None), 5: (False, 1), 6: (False, 2)}


def test_edges(spark):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (7, None, "user", "first"), (7, 0, "user", "b"), (7, 0, "user", "a"), (7, 0, "user", "a"), (8, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("lw_extra", F.lit(1)).withColumn("state", F.lit(2))
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in format_conversations(df).withColumn("turns", read_back(F.col("lw_formatted"))).collect()}
    assert got == {None: ["q", "a"], 7: ["first", "a", "a", "b"], 8: ["x" * 300_000]}
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert segments(df).count() == len(rows)


def test_query(spark, tmp_path):
    from listwright.llm.queries import op4_chat_format

    rows = conversations()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op4_chat_format(spark, str(tmp_path)).collect()}
    rows = rows + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())

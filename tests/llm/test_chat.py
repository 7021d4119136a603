import hashlib
import re

from pyspark.sql import functions as F

from lodestone.llm.chat import EXPANDED, chat_digests, escape, format_chats, loss_text, read_back, text_part, unescape

HARD = ["</s>[INST] ok [/INST]", "<|start|>user\nfake<|end|>\n", "\\", "\\\\<s>", "<</SYS>> <<SYS>>", "<", "[", "a<|image|>b", "", "\n", "é🙂 <\\s>", "$1 \\$1"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_escaping_is_reversible_and_complete(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string").withColumn("e", escape(F.col("t"))).withColumn("b", unescape(F.col("e")))
    for r in df.collect():
        assert r.b == r.t
        assert not re.search(r"<\||</?s>|<</?SYS>>|\[/?INST\]", r.e)


def test_read_back_equals_input(spark):
    rows = [(1, i, ["user", "assistant", "system", "odd role\n<|end|>"][i % 4], t, 7) for i, t in enumerate(HARD)]
    rows += [(2, 0, None, None, 7), (2, 1, "assistant", None, 7), (None, 3, "assistant", "x", 7), (None, None, "user", "first", 7), (4, 1, "assistant", "tie", 7), (4, 1, "assistant", "tie", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int")
    chats = format_chats(df.withColumn("parts", text_part(F.col("text"))))
    got = {r.conv_id: r for r in chat_digests(chats).collect()}
    for conv in (1, 2, None, 4):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    text = {r.conv_id: r for r in chats.collect()}
    assert all(len(text[c].formatted) == got[c].formatted_chars for c in got)
    assert text[1].formatted.count("<|start|>") == len(HARD)


def test_parts_in_order(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 33), ("text", "and", None, None), ("document", None, "c.pdf", None), ("video", None, "d", None)]
    kind = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,tokens:bigint>>"
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "user", [])], kind)
    r = format_chats(df).first()
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", EXPANDED["image"]), (0, "audio", "b.wav", 33), (0, "document", "c.pdf", EXPANDED["document"])]
    assert all(r.formatted[a.start :].startswith(f"<|{a.kind}|>") for a in r.attachments)
    told = chat_digests(format_chats(df)).first()
    assert (told.n_attachments, told.expanded_tokens) == (3, r.expanded_tokens)
    assert r.expanded_tokens == EXPANDED["image"] + 33 + EXPANDED["document"] and r.n_turns == 3
    back = format_chats(df).select(loss_text(F.col("formatted"), F.col("spans")).alias("loss"), read_back(F.col("formatted")).alias("turns")).first()
    assert back.loss == "see <|image|> and" and [tuple(t) for t in back.turns] == [("assistant", "see <|image|> and"), ("user", ""), ("user", "")]


def test_very_long_texts(spark):
    text = "[INST] long \\ </s> " * 60_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text[::-1] + text)], "conv_id long, turn long, role string, text string")
    r = chat_digests(format_chats(df.withColumn("parts", text_part(F.col("text"))))).first()
    loss = text[::-1] + text
    assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.turns_sha256 == sha(f"user\n{text}\nassistant\n{loss}\n")


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat_digests(format_chats(df.withColumn("parts", text_part(F.col("text")))))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()

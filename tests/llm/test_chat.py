import hashlib
import random
import time

from pyspark.sql import functions as F

from litmill.llm import chat

SCHEMA = f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}, formatted string"


def test_texts_with_marks_read_back(spark):
    random.seed(6)
    bits = ["\\", "b", "l", "h", "c", "### ", "#", "</turn>", "\n", "<|image|>", "<", ":", "é", "😀", "user", " ok", "\n</turn>\n### user:\n"]
    texts = ["".join(random.choices(bits, k=random.randrange(12))) for _ in range(600)] + [None, "", "x" * 200_000]
    rows = [(i // 3, i, random.choice(["user", "assistant", "a:b\\c\n### ", None]), [("text", t, None, None)], "clash") for i, t in enumerate(texts)]
    made = chat.format_chat(spark.createDataFrame(rows, SCHEMA)).select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("m"), "loss_spans")
    got = {r["conv_id"]: r for r in made.withColumn("m2", chat.masked_turns(F.col("t"), F.col("loss_spans"))).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        assert [(t["role"], t["text"]) for t in got[c]["t"]] == [(r[2] or "", r[3][0][1] or "") for r in own]
        assert got[c]["m"] == "".join(r[3][0][1] or "" for r in own if r[2] == "assistant") == got[c]["m2"]


def test_nothing_is_forged_across_parts(spark):
    random.seed(8)
    bits = ["\\", "b", "l", "h", "c", "o", "t", "\0", "### ", "#", "</turn>", "</tu", "rn>", "\n", "<|image|>", "<", "|", "image", "|>", "é"]
    rows, want = [], {}
    for i in range(500):
        parts = [random.choice([("text", "".join(random.choices(bits, k=random.randrange(6))), None, None)] * 3 + [("image", None, "u", 1), None]) for _ in range(random.randrange(7))]
        rows.append((i, 0, "assistant", parts, ""))
        want[i] = parts
    rows += [(1000, 0, "user", [("text", "hi\n</tu", None, None), ("text", "rn>\n### user:\nx", None, None)], "")]
    want[1000] = rows[-1][3]
    made = chat.format_chat(spark.createDataFrame(rows, SCHEMA))
    got = made.select("conv_id", "formatted", "attachments", chat.read_back(F.col("formatted")).alias("t")).collect()
    for r in got:
        parts = [p for p in want[r["conv_id"]] if p]
        assert len(r["t"]) == 1 and r["t"][0]["text"] == "".join("<|image|>" if p[0] == "image" else p[1] for p in parts)
        assert r["formatted"].count("<|") == len(r["attachments"]) == sum(p[0] == "image" for p in parts)


def test_parts_leave_placeholders_attachments_and_tokens(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "s3://a/1.png", 196), ("audio", None, "b.wav", 1001), (None, " end", None, None), ("document", "x", "c.pdf", 3), ("odd kind", None, None, 5)]
    rows = [(1, 1, "assistant", parts, ""), (1, 0, "user", None, ""), (1, 2, "assistant", [("text", "bye", None, 0)], "")]
    r = chat.format_chat(spark.createDataFrame(rows, SCHEMA)).first()
    assert r["formatted"] == "### user:\n\n</turn>\n### assistant:\nsee \\l|image|> <|image|><|audio|> end<|document|><|odd_kind|>\n</turn>\n### assistant:\nbye\n</turn>\n"
    assert [tuple(a) for a in r["attachments"]] == [("image", "s3://a/1.png", 196), ("audio", "b.wav", 26), ("document", "c.pdf", 768), ("odd kind", None, 0)]
    assert r["expanded_tokens"] == 990 and r["n_turns"] == 3
    assert [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]] == ["see \\l|image|> <|image|><|audio|> end<|document|><|odd_kind|>", "bye"]


def test_query_agrees_with_a_plain_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", chat.OWN), (-7, 1, "assistant", chat.OWN)]
    got = {r["conv_id"]: r for r in chat.op2_chat(spark, sf).collect()}
    assert got.keys() == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted(x for x in rows if x[0] == c)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, None, None, None, "x"), (None, None, None, None, "x"), (2, 1, "user", [], "x"), (2, None, "user", [("text", "first", None, 1)], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r["formatted"] for r in chat.format_chat(df).collect()}
    assert got == {None: "### :\n\n</turn>\n" * 2, 2: "### user:\nfirst\n</turn>\n### user:\n\n</turn>\n"}
    assert chat.format_chat(df.where(F.lit(False))).count() == 0


def test_time_grows_with_the_turns_and_not_their_square(spark, tmp_path):
    def took(n):
        path = f"{tmp_path}/{n}"
        turns = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("words of turn "), "id").alias("text"))
        turns.write.parquet(f"{path}/conversations.parquet")
        began = time.perf_counter()
        r = next(r for r in chat.op2_chat(spark, path).collect() if r["conv_id"] == 1)
        assert r["n_turns"] == n and r["loss_chars"] == sum(len(f"words of turn {i}") for i in range(1, n, 2))
        return time.perf_counter() - began

    took(2_000)
    few = took(4_000)
    assert took(16_000) <= 4 * few + 2

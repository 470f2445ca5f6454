"""Chat formatting: round trips, masks, attachments, odd inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat
from tidewell.llm.queries import op11_chat_formatting

BITS = ["</s>", "[INST]", "[/INST]", " ok ", "<", "[", "\\", "<\\|end|>", "<|end|>", "<|turn|>", "|", "\n", "é", "[\\/INST]", "<\\\\s>", "<|text|>", "<|image|>", "$1", "\\1", "s>", "INST]", "<s>"]
KIND = "conv_id long, turn long, role string, text string"


def rows_of(seed, n):
    r = random.Random(seed)
    text = lambda most: "".join(r.choice(BITS) for _ in range(r.randint(0, most)))
    return [(c, t, r.choice(["user", "assistant", None, "<|end|>", "a\nb", "[INST]"]), r.choice([None, "", text(12), text(4)])) for c in range(n) for t in range(r.randint(1, 5))]


def formatted(spark, rows, extra=()):
    frame = spark.createDataFrame(rows, KIND).select("*", *[F.lit("x").alias(c) for c in extra])
    return chat.format_chats(frame.withColumn("content", chat.text_part(F.col("text"))))


def escaped(text):
    return re.sub(chat.CONTROL, lambda m: m[1] + "\\" + m[2] + m[3], text)


def test_everything_is_read_back_from_the_text(spark):
    rows = rows_of(1, 60) + [(None, None, "user", "x"), (1, 0, "user", "dup"), (1, 0, "user", "dup")]
    made = formatted(spark, rows, ["n", "start", "parts", "t", "__pieces", "loss"])
    chats, read = {r.conv_id: r.chat for r in made.collect()}, {r.conv_id: r.read for r in chat.read_chats(made).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    order = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), escaped(r[3] or "").encode())
    assert chats.keys() == read.keys() == by.keys()
    for c, own in by.items():
        want = [(r[2] or "", r[3] or "") for r in sorted(own, key=order)]
        assert [(t.role, t.text) for t in read[c].turns] == want
        assert read[c].trained == "".join(t for role, t in want if role == "assistant")
        text = chats[c].text
        assert text == "".join(f"<|turn|>{escaped(role)}<|text|>{escaped(t)}<|end|>" for role, t in want)
        assert [text[s.start : s.start + s.length] for s in chats[c].loss] == [escaped(t) for role, t in want if role == "assistant"]
        assert all(text[s:].startswith("<|turn|>") for s in chats[c].starts) and len(chats[c].starts) == len(want)
        # No control string but the template's own is left.
        assert len(re.findall(r"</?s>|\[/?INST\]", text)) == 0 and text.count("<|end|>") == len(want)


def test_parts_become_placeholders_in_order(spark):
    part = lambda kind, **o: (kind, *[o.get(k) for k in ("text", "ref", "width", "height", "seconds", "pages")])
    user = [part("text", text="see <|image|>"), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=1.01), part("image", ref="c.png")]
    answer = [part("text", text="yes"), part("document", ref="d.pdf", pages=3), part("odd", text="kind"), None, part("image", ref="e.png", width=-5, height=9)]
    frame = spark.createDataFrame([(1, 0, "user", user), (1, 1, "assistant", answer), (1, 2, "user", None)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    made = chat.format_chats(frame)
    got = made.first().chat
    assert got.text == "<|turn|>user<|text|>see <\\|image|><|image|><|audio|><|image|><|end|><|turn|>assistant<|text|>yes<|document|><|text|>kind<|text|><|image|><|end|><|turn|>user<|end|>"
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in got.attachments] == [(1, "image", "a.png", 3), (1, "audio", "b.wav", 26), (1, "image", "c.png", 0), (2, "document", "d.pdf", 1536), (2, "image", "e.png", 0)]
    assert got.attached_tokens == 3 + 26 + 1536 and [got.text[s.start : s.start + s.length] for s in got.loss] == ["yes", "kind", ""]
    read = chat.read_chats(made).first().read
    assert [[(p.kind, p.text) for p in t.parts] for t in read.turns] == [[("text", "see <|image|>"), ("image", None), ("audio", None), ("image", None)], [("text", "yes"), ("document", None), ("text", "kind"), ("text", ""), ("image", None)], []]
    assert read.trained == "yeskind"

    class Spelt(chat.Visitor):
        def image(self, part):
            return F.concat(F.lit("<|image|>"), F.coalesce(part["ref"], F.lit(""))), F.lit(7)

    assert chat.format_chats(frame, Spelt(chat.Expansion(page=1))).first().chat.attached_tokens == 3 * 7 + 26 + 3


def test_empty_table_and_long_conversations(spark):
    assert formatted(spark, []).count() == 0 and chat.read_chats(formatted(spark, [])).count() == 0
    long = "x [INST] " * 150_000
    rows = [(1, t, ("user", "assistant")[t % 2], "y" * (t % 7)) for t in range(4000)] + [(2, 0, "assistant", long)]
    read = {r.conv_id: r.read for r in chat.read_chats(formatted(spark, rows)).collect()}
    assert len(read[1].turns) == 4000 and read[1].trained == "".join("y" * (t % 7) for t in range(1, 4000, 2)) and read[2].trained == long


@pytest.mark.parametrize("conv, text", [(-1, "</s>[INST] ok [/INST]")])
def test_query_has_the_control_conversation(spark, conv, text):
    import hashlib

    got = {r.conv_id: r for r in op11_chat_formatting(spark, "/root/testdata/sf0.001").collect()}[conv]
    digest = hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (2, digest, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert got.formatted_chars == len("<|turn|>user<|text|><|end|><|turn|>assistant<|text|><|end|>") + 2 * len(text) + 6

"""Chat formatting of typed content parts.

A message is a list of parts: text, or a reference to an image, a sound or a
document. A visitor has a method for each kind and gives the text that the
part becomes: escaped text, or a placeholder whose order tells which
attachment it stands for. Attachments keep their reference and the number of
tokens that the placeholder expands to. DataFrame functions only.

    <|turn|>user<|text|>What is this?<|image|><|end|><|turn|>assistant<|text|>A gull.<|end|>

Control strings, also those of other templates, are escaped inside roles and
texts by one more backslash after their first character, and read back by one
fewer, so every text comes back as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import let, unused

TURN, END = "<|turn|>", "<|end|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
KINDS = ("text", "image", "audio", "document")
#: What a text must not contain unescaped: first character, backslashes, rest.
CONTROL = r"([<\[])(\\*)(\|[A-Za-z0-9_]{1,32}\|>|/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\|[A-Za-z0-9_]{1,32}\|>|/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


@dataclass(frozen=True)
class Expansion:
    """How many tokens an attachment becomes: patches of an image, frames of a sound, a number for each page."""

    patch: int = 28
    audio_rate: float = 25.0
    page: int = 512


class Visitor:
    """Flattens parts: for each kind a method that gives (text in the output, expanded tokens).

    Subclasses may render a kind otherwise, as long as the output of a part
    begins with its own `<|kind|>`.
    """

    def __init__(self, costs: Expansion = Expansion()):
        self.costs = costs

    def text(self, part: Column) -> tuple[Column, Column]:
        return F.concat(F.lit("<|text|>"), escape(F.coalesce(part["text"], F.lit("")))), F.lit(0)

    def image(self, part: Column) -> tuple[Column, Column]:
        side = lambda c: F.ceil(F.greatest(F.coalesce(part[c], F.lit(0)), F.lit(0)) / self.costs.patch)
        return F.lit("<|image|>"), side("width") * side("height")

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * self.costs.audio_rate)

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)) * self.costs.page

    def visit(self, part: Column) -> Column:
        """struct(kind, shown, ref, tokens); parts of no known kind are read as text."""
        kind = F.when(part["kind"].isin(*KINDS), part["kind"]).otherwise("text")
        seen = {k: getattr(self, k)(part) for k in KINDS}
        pick = lambda i: F.coalesce(*[F.when(kind == k, v[i]) for k, v in seen.items()])
        return F.struct(kind.alias("kind"), pick(0).alias("shown"), part["ref"].alias("ref"), pick(1).cast("long").alias("tokens"))


def text_part(text: Column) -> Column:
    """A content of one text part."""
    none = {c: F.lit(None).cast(t) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[v.alias(c) for c, v in none.items()])).cast(f"array<{PART}>")


def format_chats(messages: DataFrame, visitor: Visitor | None = None, *, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, chat): one formatted string for each conversation.

    `messages` has conv_id, turn, role and content (an array of PART); other
    columns are left out, whatever their names. `chat` has `text`; `starts`, where
    each turn begins in it; `loss`, the spans (turn, start, length, in code points) of the
    text parts of trained roles, without marks; `attachments` in the order of
    their placeholders, with turn, kind, ref and tokens; and `attached_tokens`.

    Turns stand in the order of (turn, role, content), nulls first, so ties
    and repeated rows have one result and each row is a turn. A null role is
    an empty one, a null or empty content an empty turn, a null part or part
    text an empty text, and unknown kinds are text. Rows without a conv_id are
    one conversation. An empty table has no conversations. Rows are formatted
    before the only shuffle; a conversation is one row of the result, so its
    turns meet in one task, which sorts them with spilling.
    """
    visitor = visitor or Visitor()
    role = F.coalesce("role", F.lit(""))
    parts = F.transform(F.coalesce("content", F.array().cast(f"array<{PART}>")), visitor.visit)
    rows = messages.select("conv_id", "turn", role.alias("role"), parts.alias("parts"))
    head = F.concat(F.lit(TURN), escape(F.col("role")))
    body = F.array_join(F.transform("parts", lambda p: p["shown"]), "")
    attached = F.transform(F.filter("parts", lambda p: p["kind"] != "text"), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    spans = F.when(F.col("role").isin(*trained), _text_spans(F.col("parts"))).otherwise(F.array().cast(_SPANS))
    rows = rows.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"), attached.alias("attached"), spans.alias("spans"))
    rows = rows.withColumn("size", (F.length("head") + F.length("body") + len(END)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", "attached")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("*", before.alias("start"), F.row_number().over(order).alias("n"))
    one = F.struct("n", "start", (F.col("start") + F.length("head")).alias("from"), "spans", F.concat("head", "body", F.lit(END)).alias("shown"), "attached")
    met = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    turn = lambda t: t["n"].cast("long").alias("turn")
    loss = F.flatten(F.transform("t", lambda t: F.transform(t["spans"], lambda s: F.struct(turn(t), (t["from"] + s["start"]).alias("start"), s["length"].alias("length")))))
    files = F.flatten(F.transform("t", lambda t: F.transform(t["attached"], lambda a: F.struct(turn(t), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    tokens = F.aggregate("files", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
    met = met.select("conv_id", F.array_join(F.transform("t", lambda t: t["shown"]), "").alias("text"), F.transform("t", lambda t: t["start"]).alias("starts"), loss.alias("loss"), files.alias("files"))
    return met.select("conv_id", F.struct("text", "starts", "loss", F.col("files").alias("attachments"), tokens.alias("attached_tokens")).alias("chat"))


_SPANS = "array<struct<start:bigint,length:bigint>>"


def _text_spans(parts: Column) -> Column:
    """Where the texts of a turn's parts stand, from the first part on."""
    mark, none = len("<|text|>"), F.array().cast(_SPANS)

    def step(a: Column, p: Column) -> Column:
        n = F.length(p["shown"]).cast("long")
        found = F.when(p["kind"] == "text", F.concat(a["spans"], F.array(F.struct((a["at"] + mark).alias("start"), (n - mark).alias("length"))))).otherwise(a["spans"])
        return F.struct((a["at"] + n).alias("at"), found.alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda a: a["spans"])


def _pieces(text: Column) -> Column:
    """The turns of a formatted text, each from its mark to its end."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"(?<=<\|end\|>)(?=<\|turn\|>)"))


def read_chats(chats: DataFrame, *carry: str) -> DataFrame:
    """(conv_id, read, carried columns): what the formatted text says.

    `read` has `turns` (role, text and parts: kind, and text or the index of the
    attachment) and `trained`, all text under the loss mask, unescaped. Only
    `chat.text` is parsed; the text under the mask is cut out of it by `chat.loss`.
    """
    (pieces,) = unused(chats, "__pieces")

    def parse(piece: Column) -> Column:
        # From the last character of the mark on, as a split at the very start gives no empty string.
        inner = F.substring(piece, len(TURN), F.length(piece) - len(TURN) - len(END) + 1)
        parts = F.split(inner, r"(?=<\|(?:text|image|audio|document)\|>)")

        def part(p: Column) -> Column:
            kind = F.regexp_extract(p, r"^<\|([a-z]+)\|>", 1)
            return F.struct(kind.alias("kind"), F.when(kind == "text", unescape(F.substring(p, len("<|text|>") + 1, F.length(p)))).alias("text"))

        return let(parts, lambda q: let(F.transform(F.slice(q, 2, F.greatest(F.size(q) - 1, F.lit(0))), part), lambda found: F.struct(
            unescape(F.substring(F.get(q, F.lit(0)), 2, F.length(piece))).alias("role"), F.array_join(F.transform(found, lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("text"), found.alias("parts"))))

    # Spans are cut out of their turn, as each look into the whole text would walk through it.
    def cut(span: Column) -> Column:
        i = (span["turn"] - 1).cast("int")
        return F.substring(F.get(F.col(pieces), i), (span["start"] - F.get(F.col("chat.starts"), i) + 1).cast("int"), span["length"].cast("int"))

    rows = chats.withColumn(pieces, _pieces(F.col("chat.text")))
    rows = rows.select("conv_id", *carry, F.transform(pieces, parse).alias("turns"), F.array_join(F.transform("chat.loss", lambda s: unescape(cut(s))), "").alias("trained"))
    return rows.select("conv_id", F.struct("turns", "trained").alias("read"), *carry)

"""Chat formatting with typed content parts (operator 4), in DataFrame functions.

A turn's content is an array of parts: text, image, audio or document. A visitor with one rule for each kind flattens
the parts, in order, into escaped text and placeholders, records a reference for every attachment, and counts the
tokens that the placeholders stand for once they are expanded.

The template writes a turn as ``<|turn|>role<|says|>content<|end|>``. In texts a backslash is doubled and a backslash
is put behind the first character of every control string, so no text can be read as a control string, and reading
``\\\\`` as a backslash and dropping single ones gives the text back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: All strings that no text may contain unescaped: the template's own begin with ``<|``, the rest are other templates'.
CONTROL = r"<\||</?s>|\[/?INST\]|<</?SYS>>"
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"(?=(?:{CONTROL}))(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


@dataclass
class Visitor:
    """Rules by kind: what a part shows as in the text, and how many tokens it expands to."""

    patch: int = 28
    tokens_per_second: float = 25.0
    tokens_per_page: int = 400
    count_text: Callable[[Column], Column] = lambda text: F.regexp_count(text, F.lit(r"\S+"))
    kinds: tuple[str, ...] = field(default=("image", "audio", "document"))

    def show(self, part: Column, i: Column, before: Column) -> Column:
        """Text is escaped; an attachment is ``<|kind:position|>``; any other kind shows its escaped text.

        A text behind another text begins with a single backslash, which reading drops, so that no two join up to a control
        string; one that begins with a backslash itself needs none.
        """
        mark = F.concat(F.lit("<|"), part["kind"], F.lit(":"), i.cast("string"), F.lit("|>"))
        text = F.coalesce(part["text"], F.lit(""))
        apart = F.when((i > 0) & ~F.coalesce(before["kind"].isin(*self.kinds), F.lit(False)) & (text != "") & ~text.startswith("\\"), F.lit("\\")).otherwise(F.lit(""))
        return F.when(part["kind"].isin(*self.kinds), mark).otherwise(F.concat(apart, escape(text)))

    def tokens(self, part: Column) -> Column:
        size = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / F.lit(self.patch))
        return (
            F.when(part["kind"] == "image", size(part["width"]) * size(part["height"]))
            .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.tokens_per_second))
            .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * self.tokens_per_page)
            .otherwise(self.count_text(F.coalesce(part["text"], F.lit("")))).cast("long")
        )


def text_part(text: Column) -> Column:
    """Content of one text part."""
    fields = {"kind": F.lit("text"), "text": text, "ref": F.lit(None).cast("string"), "width": F.lit(None).cast("int"), "height": F.lit(None).cast("int"), "seconds": F.lit(None).cast("double"), "pages": F.lit(None).cast("int")}
    return F.array(F.struct(*[v.alias(k) for k, v in fields.items()]))


def format_chats(turns: DataFrame, visitor: Visitor | None = None) -> DataFrame:
    """``turns(conv_id, turn, role, parts)`` -> one row for each conversation.

    ``(conv_id, n_turns, formatted, attachments, n_tokens, loss)``: ``attachments`` are structs (turn, position, kind, ref,
    tokens) in order; ``loss`` are structs (start, length) in code points of ``formatted``, one for each assistant turn's
    content. Turns are in the order of turn (null first), then role, then content; repeated rows are repeated turns.
    Null roles and texts are empty, null parts are no parts, a null conv_id is a conversation of its own, an empty
    table gives an empty one; other columns are not read. A conversation is one row, so its turns meet in one task.
    """
    v = visitor or Visitor()
    parts = F.coalesce("parts", F.expr(f"cast(array() AS array<{PART}>)"))
    shown = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda p, i: v.show(p, i, F.get(parts, i - 1))), "").alias("content"),
        F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("position"), p["kind"].alias("kind"), p["ref"].alias("ref"), v.tokens(p).alias("tokens"))), lambda a: a["kind"].isin(*v.kinds)).alias("files"),
        F.aggregate(F.transform(parts, v.tokens), F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"),
    )
    turn = F.struct("turn", "role", "content", "files", "tokens", F.length("content").alias("size"))
    chats = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(SAYS), t["content"], F.lit(END)))
    files = F.flatten(F.transform("turns", lambda t: F.transform(t["files"], lambda f: F.struct(t["turn"].alias("turn"), f["position"].alias("position"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<struct<start: int, length: int>>)").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + len(TURN) + len(SAYS) + F.length(escape(t["role"]))
        span = F.array(F.struct(begin.alias("start"), t["size"].alias("length")))
        return F.struct((begin + t["size"] + len(END)).alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(written, "").alias("formatted"), files.alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"), F.aggregate("turns", start, step, lambda s: s["spans"]).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: structs (role, text), unescaped; placeholders stay as written."""
    turn = r"(?s)<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>"
    whole = F.regexp_extract_all(formatted, F.lit(turn), F.lit(0))
    return F.transform(whole, lambda t: F.struct(unescape(F.regexp_extract(t, turn, 1)).alias("role"), unescape(F.regexp_extract(t, turn, 2)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))

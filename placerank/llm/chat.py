"""Chat formatting of typed content parts.

A message is a list of parts: text, image, audio or document.  A visitor flattens them in order: text is escaped, any other part becomes a
placeholder of its kind, and its attachment is recorded with its reference, its place in the formatted text and the tokens
its placeholder expands to.  Turns are marked by control strings; wherever one occurs inside a text or role a backslash
after its first character breaks it, and backslashes are doubled, so that the output parses back to what went in.
The loss mask covers the texts of one role, without markers and placeholders.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's own markers, then strings that other templates give meaning to; all are broken up inside texts.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
FOREIGN = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>"]
CONTROL = re.compile("|".join(re.escape(x) for x in [TURN, BODY, END, *PLACEHOLDERS.values(), *FOREIGN]))
PART = "struct<type:string,text:string,ref:string,amount:double>"
#: Tokens a placeholder expands to, from the part's amount: tiles of an image, seconds of audio, pages of a document.
TOKENS = {"image": (85, 170), "audio": (0, 25), "document": (0, 800)}
OUTPUT = (
    "conv_id long, formatted string, mask array<struct<start:long,end:long>>, "
    "attachments array<struct<type:string,ref:string,at:long,tokens:long>>, n_turns long, expanded_tokens long"
)


def escape(text: str) -> str:
    """Backslashes doubled, and one put after the first character of every control string."""
    text = text.replace("\\", "\\\\")
    broken = CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
    while CONTROL.search(broken):  # strings that overlap: one pass leaves the second whole
        broken = CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], broken)
    return broken


def unescape(text: str) -> str:
    """The inverse of `escape`: a pair of backslashes is one, a single one is dropped."""
    return re.sub(r"\\(\\?)", r"\1", text)


def tokens_of(kind: str, amount: float | None) -> int:
    base, each = TOKENS[kind]
    known = amount is not None and math.isfinite(amount) and amount > 0
    return base + each * (math.ceil(amount) if known else 1)


class Visitor:
    """Builds one conversation's text, loss mask and attachments; positions are code points."""

    def __init__(self, loss_role: str) -> None:
        self.loss_role, self.out, self.at = loss_role, [], 0
        self.mask: list[tuple[int, int]] = []
        self.attachments: list[tuple[str, str | None, int, int]] = []

    def put(self, piece: str) -> None:
        self.out.append(piece)
        self.at += len(piece)

    def text(self, said: str, learned: bool) -> None:
        start = self.at
        self.put(escape(said))
        if learned and self.at > start:
            self.mask.append((start, self.at))

    def attachment(self, kind: str, ref: str | None, amount: float | None) -> None:
        self.attachments.append((kind, ref, self.at, tokens_of(kind, amount)))
        self.put(PLACEHOLDERS[kind])

    def message(self, role: str, parts: list) -> None:
        """Neighbouring text parts are one text, so that no control string arises between two; a part of unknown type
        counts as text."""
        self.put(TURN + escape(role) + BODY)
        learned, said = role == self.loss_role, []
        for part in parts:
            if part["type"] in PLACEHOLDERS:
                self.text("".join(said), learned)
                said = []
                self.attachment(part["type"], part["ref"], part["amount"])
            else:
                said.append(part["text"] or "")
        self.text("".join(said), learned)
        self.put(END)


def format_chats(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, parts): OUTPUT.

    Messages are in order of turn (null first), ties by role and parts; null roles and texts are empty, a null conv_id
    is a conversation of its own; repeated rows are said twice.  A conversation is one output row, so its messages meet
    in one task: the list is built by an aggregate, and formatting streams over conversations."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, turns in zip(batch["conv_id"], batch["turns"], strict=True):
                v = Visitor(loss_role)
                for t in turns:
                    v.message(t["role"], t["parts"])
                rows.append((
                    None if pd.isna(conv) else int(conv), "".join(v.out), [dict(zip(("start", "end"), m, strict=True)) for m in v.mask],
                    [dict(zip(("type", "ref", "at", "tokens"), a, strict=True)) for a in v.attachments], len(turns), sum(a[3] for a in v.attachments),
                ))
            out = pd.DataFrame(rows, columns=["conv_id", "formatted", "mask", "attachments", "n_turns", "expanded_tokens"])
            yield out.astype({"conv_id": "Int64"})

    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.col("parts").alias("parts"))
    chats = messages.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return chats.mapInPandas(run, OUTPUT)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; text without placeholders, unescaped."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, _, body = piece.removeprefix(TURN).partition(BODY)
        for mark in PLACEHOLDERS.values():
            body = body.replace(mark, "")
        turns.append((unescape(role), unescape(body)))
    return turns


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the formatted text and its mask alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, text, mask in zip(batch["conv_id"], batch["formatted"], batch["mask"], strict=True):
                turns = parse(text)
                said = "".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")
                learned = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                rows.append((
                    None if pd.isna(conv) else int(conv), len(turns), hashlib.sha256(said).hexdigest(), len(learned),
                    hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(text),
                ))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield out.astype({"conv_id": "Int64"})

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.select("conv_id", "formatted", "mask").mapInPandas(run, schema)


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount")))


def chat_report(conversations: DataFrame) -> DataFrame:
    """Format (conv_id, turn, role, text) rows and conversation -7, whose two texts imitate control strings; read back."""
    spoof = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).union(spoof)
    return read_back(format_chats(rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))

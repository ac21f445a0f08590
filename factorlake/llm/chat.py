"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, whose context is all that
was said before and whose reply alone is trainable.

Each turn is a piece of its conversation's stream; an example is the stream from its beginning to the end of one reply,
spelled out in whole, with a mask over that reply. Roles, texts and replies are read back from the examples. The text of
all examples grows with the square of a conversation's turns, as the method does; they are made by the task that sorts
the conversation's turns and flow on one by one, so they aren't gathered.

Turns are marked by the control strings of CONTROLS. Where a text holds one of them, a backslash is put behind its first
character, and each backslash of the text itself is doubled: no control string is left in a text, and dropping one
backslash of each pair or group gives the text back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, whole

# What stands before and after a turn's text, by role; roles with no entry are written by name.
MARKS = {
    "user": ("<s>[INST] ", " [/INST]"),
    "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"),
    "assistant": (" ", " </s>"),
}
OTHER = ("[ROLE:", "] ", " [/ROLE]")
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE:", "[/ROLE]"]
REPLY = "assistant"

_BEGINS = r"([<\[])(?=s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE:|/ROLE\])"
_OTHER_TURN = r"(?s)^\[ROLE:((?:\\.|[^\\\]])*)\] (.*) \[/ROLE\]$"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BEGINS, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, side: int, other: Column) -> Column:
    found = F
    for name, marks in MARKS.items():
        found = found.when(role == name, F.lit(marks[side]))
    return found.otherwise(other)


def format_turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, example, piece, start, end, loss_start, loss_end, expansion): the formatted turns of all conversations.

    `piece` is the turn as written; pieces by `place` (0, 1, ... in a conversation) are its stream, in which `start` and
    `end` are the piece's code points, end exclusive. `example` counts the replies before the turn, so a reply of
    example k is the target of example k, whose text is the stream up to the reply's `end`; loss_start and loss_end are
    the mask, null but on replies. Turns after the last reply belong to an example without a mask. `expansion` is the
    example's text with its whole prefix, on the turn that ends the example; null on other turns.

    Turns go by `turn`, nulls first; those that tie by role and then by a hash of their text. A null role is an empty
    one, a null text an empty text; rows with a null conversation are one conversation; rows that repeat are turns each;
    an empty table gives an empty result; other columns are not read. A conversation may be of any length: its turns
    spread over partitions, each sums up its own, and at most one conversation goes on from one partition to the next,
    so what is broadcast has a row for each partition at most.
    """
    who, said = whole(F.col(role).cast("string")), whole(F.col(text).cast("string"))
    turns = df.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("__turn"), who.alias("__role"), F.xxhash64(said).alias("__hash"), said.alias("__text"))
    sorted_turns = in_order(turns, "conv_id", "__turn", "__role", "__hash")
    named = F.concat(F.lit(OTHER[0]), F.replace(escape(F.col("__role")), F.lit("]"), F.lit("\\]")), F.lit(OTHER[1]))
    pieces = (
        sorted_turns.withColumn("__body", escape(F.col("__text")))
        .withColumns({"__before": _by_role(F.col("__role"), 0, named), "__after": _by_role(F.col("__role"), 1, F.lit(OTHER[2]))})
        .select(
            "conv_id", "__part", "__row",
            F.concat("__before", "__body", "__after").alias("piece"),
            F.char_length("__before").cast("long").alias("__at"),
            F.char_length("__body").cast("long").alias("__size"),
            (F.col("__role") == REPLY).alias("__reply"),
        )
        .withColumn("__chars", F.char_length("piece").cast("long"))
    )
    replies = F.col("__reply").cast("long")
    sums = {"place": F.lit(1), "start": F.col("__chars"), "example": replies}
    spans = pieces.groupBy("conv_id", "__part").agg(*[F.sum(x).alias(f"__{n}") for n, x in sums.items()])
    earlier = Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("conv_id", "__part", *[F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in sums]).filter("__place is not null")
    within = Window.partitionBy("__part", "conv_id").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select("*", *[F.coalesce(F.sum(x).over(within), F.lit(0)).alias(n) for n, x in sums.items()]).alias("a")
    joined = placed.join(F.broadcast(carried.alias("b")), F.expr("a.__part = b.__part and a.conv_id <=> b.conv_id"), "left")
    moved = {n: F.col(f"a.{n}") + F.coalesce(F.col(f"b.__{n}"), F.lit(0)) for n in sums}
    begins = moved["start"] + F.col("a.__at")
    placed = joined.select(
        "a.conv_id", moved["place"].alias("place"), moved["example"].alias("example"), "a.piece",
        moved["start"].alias("start"), (moved["start"] + F.col("a.__chars")).alias("end"),
        F.when(F.col("a.__reply"), begins).alias("loss_start"), F.when(F.col("a.__reply"), begins + F.col("a.__size")).alias("loss_end"),
    )
    upto = Window.partitionBy("conv_id").orderBy("place")
    prefix = F.collect_list("piece").over(upto.rowsBetween(Window.unboundedPreceding, 0))
    told = placed.withColumns({"__prefix": prefix, "__last": F.lead("place").over(upto).isNull()})
    ends = F.col("loss_start").isNotNull() | F.col("__last")
    return told.withColumn("expansion", F.when(ends, F.array_join("__prefix", ""))).drop("__prefix", "__last")


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, turns, context_chars, chars, loss_start, loss_end) of every example of format_turns().

    An example's text is its conversation's stream up to `chars`; the context is what stands before its reply. Turns
    that no reply follows are an example without a mask, of which nothing is trained."""
    reply = F.col("loss_start").isNotNull()
    return turns.groupBy("conv_id", "example").agg(
        (F.max("place") + 1).alias("turns"), F.coalesce(F.max(F.when(reply, F.col("start"))), F.max("end")).alias("context_chars"),
        F.max("end").alias("chars"), F.max("loss_start").alias("loss_start"), F.max("loss_end").alias("loss_end"),
    )


def example_texts(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): examples spelled out, each with its whole context.

    This is what a trainer reads. Its size grows with the square of a conversation's turns, as the task does, and an
    example is one cell."""
    return turns.filter("expansion IS NOT NULL").select("conv_id", "example", F.col("expansion").alias("text"), "loss_start", "loss_end")


def read_turns(turns: DataFrame) -> DataFrame:
    """The columns of format_turns(), less the examples' texts, with role, text and reply (the text under the mask) of each
    turn and formatted (the example's characters, on the turn that ends it), all read from the examples' texts.

    An example's text tells the turns since the one before ended; its mask tells the reply."""
    spans = F.sort_array(F.collect_list(F.struct("place", "start", "end", "loss_start", "loss_end")))
    examples_ = turns.groupBy("conv_id", "example").agg(spans.alias("__turns"), F.max("expansion").alias("__text"))
    each = examples_.select("conv_id", "example", "__text", F.posexplode("__turns").alias("__i", "t"), F.size("__turns").alias("__n")).select("conv_id", "example", "__text", "t.*", (F.col("__i") + 1 == F.col("__n")).alias("__ends"))
    part = lambda a, z: F.substring("__text", (F.col(a) + 1).cast("int"), (F.col(z) - F.col(a)).cast("int"))
    read = each.select(
        "conv_id", "place", "example", part("start", "end").alias("piece"), "start", "end", "loss_start", "loss_end",
        part("loss_start", "loss_end").alias("__reply"), F.when(F.col("__ends"), F.char_length("__text").cast("long")).alias("formatted"),
    )
    piece = F.col("piece")
    role, text = F, F
    for name, (before, after) in MARKS.items():
        found = piece.startswith(before) & piece.endswith(after)
        role = role.when(found, F.lit(name))
        text = text.when(found, F.substring(piece, len(before) + 1, F.char_length(piece) - len(before) - len(after)))
    role = role.otherwise(F.regexp_extract(piece, _OTHER_TURN, 1))
    text = text.otherwise(F.regexp_extract(piece, _OTHER_TURN, 2))
    return read.withColumns({"role": unescape(role), "text": unescape(text), "reply": unescape(F.col("__reply"))}).drop("__reply")


def digest_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of read_turns().

    A conversation's turns stream through one task in their order, for a digest goes byte by byte; the task holds a
    batch of them at a time. formatted_chars: the characters of all examples, each with its whole context."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        now, began = None, False
        for batch in rows:
            for key, role, text, reply, size in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if not began or key != now:
                    if began:
                        made.append((now, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), total))
                    now, began, n, chars, total = key, True, 0, 0, 0
                    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                n += 1
                turns_hash.update(f"{role}\n{text}\n".encode())
                total += size or 0
                if reply is not None:
                    loss_hash.update(reply.encode())
                    chars += len(reply)
            if len(made) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in made], out)
                made = []
        if began:
            made.append((now, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), total))
        yield pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in made], out)

    texts = ["turns_sha256", "loss_sha256"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = turns.schema["conv_id"].dataType.simpleString()
    if kind not in ("bigint", "string", "int"):
        raise ValueError(f"conversations are known by an integer or a string, not {kind}")
    arrow = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}[kind]
    out = pa.schema([(n, arrow if n == "conv_id" else pa.string() if n in texts else pa.int64()) for n in names])
    read = turns.select("conv_id", "role", "text", "reply", "formatted", "place").repartition("conv_id").sortWithinPartitions("conv_id", "place").drop("place")
    return read.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

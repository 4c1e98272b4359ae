r"""Chat formatting: every assistant turn becomes an example of its own.

A turn is written as ``<turn role="...">text</turn>`` and a line break. Inside
roles and texts a backslash is doubled, and one is put before a quote in a role and
before ``<`` where ``turn`` or ``/turn`` follows, so that no text can write a
control string; :func:`read` undoes it.

An example is a prefix of its conversation (all turns before, as context) and one
assistant reply, which alone is trainable. :func:`formatted` expands a conversation
into such examples, one for each reply, each with its whole context. Turns that no
reply follows are in no such context, so the last of them makes an example of its
own, in which nothing is trained. A conversation of n replies is written up to n
times, so the output grows with the square of its length; that is never shuffled or
stored here, and a worker holds one prefix and a few million characters of output.

Turns go by turn number, nulls first, then role and text for ties, and repeated
rows are turns of their own. Null role or text counts as empty, rows of null
conv_id are one conversation, and only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
#: Characters of examples that an output batch takes before it goes.
BATCH_CHARS = 4_000_000
TURN = re.compile(r'<turn role="((?:[^\\"]|\\.)*)">((?:[^\\<]+|\\.|<(?!/?turn))*)</turn>\n', re.S)


def escaped(text: Column, quotes: bool = False) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    if quotes:
        text = F.replace(text, F.lit('"'), F.lit('\\"'))
    return F.regexp_replace(text, r"<(?=/?turn)", r"\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read(chunk: str, at: int = 0) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text, from character ``at`` on."""
    out = []
    while at < len(chunk):
        found = TURN.match(chunk, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def written(conversations: DataFrame) -> DataFrame:
    """A row per turn, in order within its conversation, each turn by itself.

    conv_id, position (from 0), chunk (the turn as written), trained, last (of its
    conversation), loss_start and loss_end (code points from the conversation's first).
    """
    head = F.concat(F.lit('<turn role="'), escaped(F.col("role"), True), F.lit('">'))
    body = escaped(F.col("text"))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), head.alias("head"), body.alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    chunk = F.concat("head", "body", F.lit("</turn>\n"))
    start = F.coalesce(F.sum(F.length(chunk).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    last = F.lead("head").over(order).isNull()
    placed = rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("position"), "role", "head", "body", chunk.alias("chunk"), start.alias("chunk_start"), last.alias("last"))
    trained = F.col("role") == TRAINED_ROLE
    begin = F.col("chunk_start") + F.length("head")
    return placed.select("conv_id", "position", "chunk", trained.alias("trained"), "last", F.when(trained, begin).alias("loss_start"), F.when(trained, begin + F.length("body")).alias("loss_end"))


def formatted(conversations: DataFrame) -> DataFrame:
    """A row per example: every assistant turn with all turns before it.

    conv_id, example (from 0 within its conversation), position (of its last turn),
    context (all turns before that), reply (that turn as written), trained, loss_start
    and loss_end (code points of context and reply together, which the mask covers). A
    conversation that ends with another role has one row more, not trained, with its
    last turn as reply and without a mask. Rows of a conversation lie in one partition,
    in order. One conversation's text so far is held at a time.
    """
    turns = written(conversations)
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "example", "position", "context", "reply", "trained", "loss_start", "loss_end"]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, example, context, since = 0, 0, "", []

        def flushed(id_type: pa.DataType) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv_id, position, chunk, trained, last, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if position == 0:
                    example, context, since = 0, "", []
                if trained or last:
                    context, since = context + "".join(since), []
                    rows.append((conv_id, example, position, context, chunk, trained, start, end))
                    example += 1
                    size += len(context) + len(chunk)
                since.append(chunk)
                if size >= BATCH_CHARS:
                    yield flushed(id_type)
                    rows, size = [], 0
            if rows:
                yield flushed(id_type)
                rows, size = [], 0

    return ordered(turns).mapInArrow(expand, f"conv_id {kind}, example long, position long, context string, reply string, trained boolean, loss_start long, loss_end long")


def with_text(examples: DataFrame) -> DataFrame:
    """The examples of :func:`formatted` to train on: conv_id, position, context, reply, loss_start, loss_end."""
    return examples.where("trained").select("conv_id", "position", "context", "reply", "loss_start", "loss_end")


def ordered(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from the texts and masks of its examples.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    ``examples`` are the rows of :func:`formatted`, in its order. Each context must
    repeat the example before it to the character; the turns after that are read, so
    each turn counts once, and so does each masked text. The last example is as long
    as the conversation.
    """
    kind = examples.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        seen, due = "", 0

        def done() -> tuple:
            conv_id, n, all_, chars, loss = now
            return conv_id, n, all_.hexdigest(), chars, loss.hexdigest(), len(seen)

        def record(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            out = []
            for i in range(batch.num_rows):
                conv_id, example, context, reply, trained, start, end = (column[i].as_py() for column in batch.columns)
                if example == 0:
                    if now:
                        out.append(done())
                    now, seen, due = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256()], "", 0
                if example != due or not context.startswith(seen):
                    raise ValueError(f"example {example} of conversation {conv_id} does not go on from the one before")
                text = context + reply
                for role, said in read(text, len(seen)):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                if trained:
                    said = unescape(text[start:end])
                    now[3] += len(said)
                    now[4].update(said.encode())
                seen, due = text, example + 1
            if out:
                yield record(out, id_type)
        if now:
            yield record([done()], id_type)

    rows = examples.select("conv_id", "example", "context", "reply", "trained", "loss_start", "loss_end")
    return rows.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

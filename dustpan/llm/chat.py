"""Conversations rebuilt from event logs and rendered for training.

An event log has one row per event: conv_id, seq, kind, msg, role, text.

=============  =====================================================================
``start``      opens message ``msg`` with ``role`` and the first piece of its text
``delta``      appends ``text`` to the message
``edit``       replaces the message's text
``regenerate`` empties the message (deltas follow) and withdraws every later
               message that was opened before this event
``delete``     withdraws the message alone
=============  =====================================================================

Messages stand in the order of their first ``start``.  Events of a message
count from its last ``start``, ``edit`` or ``regenerate`` on, in order of seq;
equal seq are ordered by kind and text, so any partitioning gives the same
result.  A message without a ``start`` has nothing to belong to and is left
out.  Null texts are empty, null roles are empty roles, a null conv_id is a
conversation of its own.

Folding is per message: a conversation with a third of all events spreads over
many tasks.  Rendering gives one row per turn, whose segments in order of
``turn`` are the formatted conversation, so no task or cell needs a whole
conversation, and a reader goes through them as a stream.

Template: ``<s>``, then per turn ``<|turn|>role<|text|>text<|end|>``, then ``</s>``.
A control string inside a role or text gets a backslash behind its first
character (and one more if it has some already), which is undone on reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KINDS = ("start", "delta", "edit", "regenerate", "delete")
OPEN, TURN, TEXT, END, CLOSE = "<s>", "<|turn|>", "<|text|>", "<|end|>", "</s>"
# Control strings of this and other common templates: first character, rest.
_CONTROL = r"/?s>|\|[A-Za-z0-9_]{1,32}\|>|/?INST\]|<\/?SYS>>"
_ESCAPE = rf"([<\[])(\\*)(?={_CONTROL})"
_PLAIN = rf"([<\[])\\(\\*)(?={_CONTROL})"


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): final messages, turns numbered from 0 in each conversation."""
    rows = events.select("conv_id", "seq", "kind", "msg", "role", F.coalesce("text", F.lit("")).alias("text"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    rows = rows.select("conv_id", "msg", "kind", "role", "text", F.struct("seq", rank.alias("rank"), "text").alias("at"))
    message = W.partitionBy("conv_id", "msg")
    opens = F.col("kind").isin("start", "edit", "regenerate")
    marked = rows.select(
        "*", F.max(F.when(opens, F.col("at"))).over(message).alias("since"),
        F.min(F.when(F.col("kind") == "start", F.col("at"))).over(message).alias("opened"))
    pieces = F.when(F.col("at") >= F.col("since"), F.when(F.col("kind").isin("start", "delta", "edit"), F.struct("at", "text")))
    texts = F.array_sort(F.collect_list(pieces))
    messages = (marked.where("opened IS NOT NULL").groupBy("conv_id", "msg").agg(
        F.first("opened").alias("opened"),
        F.coalesce(F.max_by("role", F.when(F.col("kind") == "start", F.col("at"))), F.lit("")).alias("role"),
        F.array_join(F.transform(texts, lambda p: p["text"]), "").alias("text"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("at"))).alias("again"),
        F.max((F.col("kind") == "delete").cast("int")).alias("gone")))
    earlier = W.partitionBy("conv_id").orderBy("opened", "msg").rowsBetween(W.unboundedPreceding, -1)
    standing = (messages.withColumn("__again", F.max("again").over(earlier))
                .where("gone = 0 AND (__again IS NULL OR __again < opened)"))
    turn = F.row_number().over(W.partitionBy("conv_id").orderBy("opened", "msg")) - 1
    return standing.select("conv_id", turn.cast("bigint").alias("turn"), "role", "text")


def _escaped(text):
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: str) -> str:
    return re.sub(_PLAIN, r"\1\2", text)


def render(turns: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end) per turn.

    The segments of a conversation joined in order of ``turn`` are its formatted
    text; code points loss_start to loss_end (exclusive) of a segment are under
    the loss mask, null where the role is not ``learned``.
    """
    order = W.partitionBy("conv_id").orderBy("turn")
    head = F.concat(F.when(F.lag("turn").over(order).isNull(), OPEN).otherwise(""), F.lit(TURN), _escaped(F.col("role")), F.lit(TEXT))
    tail = F.concat(F.lit(END), F.when(F.lead("turn").over(order).isNull(), CLOSE).otherwise(""))
    rows = turns.select("conv_id", "turn", "role", _escaped(F.col("text")).alias("body"), head.alias("head"), tail.alias("tail"))
    start = F.when(F.col("role").isin(*learned), F.length("head"))
    return rows.select("conv_id", "turn", F.concat("head", "body", "tail").alias("segment"), start.cast("bigint").alias("loss_start"),
                       (start + F.length("body")).cast("bigint").alias("loss_end"))


_TURN = re.compile(r"\A(?:<s>)?<\|turn\|>(.*?)<\|text\|>(.*)<\|end\|>(?:</s>)?\Z", re.DOTALL)


def read_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a rendered turn."""
    role, text = _TURN.match(segment).groups()
    return unescape(role), unescape(text)


def digests(segments: DataFrame) -> DataFrame:
    """What can be read back from rendered turns, one row per conversation.

    Conversations are streamed through tasks in order, so memory is that of a turn.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None

        def row():
            n, turns, chars, loss, length = state
            return (current[0], n, turns.hexdigest(), chars, loss.hexdigest(), length)

        for batch in batches:
            done = []
            for conv, segment, at, to in zip(batch["conv_id"], batch["segment"], batch["loss_start"], batch["loss_end"], strict=True):
                conv = None if pd.isna(conv) else conv
                if current != (conv,):
                    if current:
                        done.append(row())
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_segment(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if not pd.isna(at):
                    learned = unescape(segment[int(at):int(to)])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            yield pd.DataFrame(done, columns=names)
        if current:
            yield pd.DataFrame([row()], columns=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInPandas(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

"""Chat formatting, assembled from tokens.

A turn is  <turn> role </role> text </turn> . Role and text are encoded separately, each whole, and the three control
ids are spliced between: they lie past the vocabulary, so no text can produce them. In the readable form the controls are
the strings in ``CONTROLS``; where one (or a backslash) occurs in a role or text it gets a backslash in front, which
``unescape`` takes away again, so both forms can be read back exactly.

The loss mask covers the tokens of assistants' texts alone (``end_in_loss`` adds the ids that close those turns): +1 at
the start and -1 past the end of each such segment, summed up. Places of a turn within its conversation are running sums over
the turns before it. Output is a row a turn, so a conversation of any length is never held together; its tokens are those of
its turns in order.

Defined cases: a null or empty text is a turn without text; a null role is an empty role and gets no loss; turns are ordered by
turn (null first), then role, then text, so ties and repeated rows are turns too; rows without a conv_id form one conversation
of their own; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.store import bounded_batches
from rillstone.llm.tokens import encoder, vocabulary

CONTROLS = ("<turn>", "</role>", "</turn>")
FIRST_CONTROL = 50_257  # ids of CONTROLS in order, past the 50,257 of the vocabulary
LOSS_ROLES = ("assistant",)
_NEEDS = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _NEEDS.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def assemble(segments: list[tuple[np.ndarray | int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """ids and loss mask from segments (ids, or one reserved id; whether it is learnt)."""
    parts = [np.array([s], "<u4") if isinstance(s, int) else s for s, _ in segments]
    stops = np.cumsum([len(p) for p in parts])
    turns = np.zeros(int(stops[-1]) + 1, np.int64)
    for (_, loss), part, stop in zip(segments, parts, stops.tolist(), strict=True):
        if loss:
            turns[stop - len(part)] += 1
            turns[stop] -= 1
    return np.concatenate(parts), np.cumsum(turns)[:-1] > 0


def format_turns(
    turns: DataFrame, tokenizer: str | None = None, loss_roles: tuple[str, ...] = LOSS_ROLES, end_in_loss: bool = False, first_control: int = FIRST_CONTROL
) -> DataFrame:
    """A row a turn: conv_id, turn, n (place within the conversation, from 0), rendered, ids, loss (mask), token_start, char_start."""
    bounded_batches(turns.sparkSession)
    tokenizer = tokenizer or vocabulary()
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, plain=True)
        open_, mid, close = range(first_control, first_control + 3)
        for b in batches:
            roles, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
            kept_roles, kept_texts = list(map(escape, roles)), list(map(escape, texts))
            out = []
            for role, r, t in zip(roles, encode.each(kept_roles), encode.each(kept_texts), strict=True):
                learnt = role in loss_roles
                out.append(assemble([(open_, False), (r, False), (mid, False), (t, learnt), (close, learnt and end_in_loss)]))
            rendered = [f"{CONTROLS[0]}{r}{CONTROLS[1]}{t}{CONTROLS[2]}" for r, t in zip(kept_roles, kept_texts, strict=True)]
            ids = pa.array([x.astype(np.int32) for x, _ in out], pa.list_(pa.int32()))
            loss = pa.array([x for _, x in out], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rendered, pa.string()), ids, loss], names=["conv_id", "turn", "role", "text", "rendered", "ids", "loss"])

    made = rows.mapInArrow(run, "conv_id long, turn long, role string, text string, rendered string, ids array<int>, loss array<boolean>")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return made.select(
        "conv_id",
        "turn",
        (F.row_number().over(order) - 1).cast("long").alias("n"),
        "rendered",
        "ids",
        "loss",
        F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).alias("token_start"),
        F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)).alias("char_start"),
    )


def read_turn(ids: np.ndarray, loss: np.ndarray, decode, first_control: int = FIRST_CONTROL) -> tuple[str, str, str]:
    """role, text and the text under the mask, read from the tokens of one turn."""
    at = np.nonzero(ids >= first_control)[0].tolist()
    if [int(ids[k]) - first_control for k in at] != [0, 1, 2] or at[0] != 0 or at[2] != len(ids) - 1:
        raise ValueError("not the tokens of a turn")
    text = lambda x: unescape(decode(x.tolist()))
    learnt = ids[loss]
    body = ids[at[1] + 1 : at[2]]
    whole = text(body)
    learnt = learnt[learnt < first_control]
    return text(ids[1 : at[1]]), whole, whole if np.array_equal(learnt, body) else text(learnt)


def read_back(formatted: DataFrame, tokenizer: str | None = None, first_control: int = FIRST_CONTROL) -> DataFrame:
    """One row per conversation, from the tokens alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The digests run over a conversation's turns in order; a task streams its sorted turns and keeps two hash states, so
    a conversation may be longer than its memory."""
    bounded_batches(formatted.sparkSession)
    tokenizer = tokenizer or vocabulary()
    rows = (
        formatted.select("conv_id", "n", "ids", "loss", F.length("rendered").alias("chars"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "n")
    )
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = encoder(tokenizer, plain=True).tokenizer.decode
        decode = lambda x: decode_ids(x, skip_special_tokens=False) if x else ""
        now: list | None = None

        def told() -> tuple:
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        for b in batches:
            done = []
            for conv, ids, loss, chars in zip(b.column(0).to_pylist(), b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(told())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, learnt = read_turn(np.asarray(ids.values), np.asarray(loss.values.to_numpy(zero_copy_only=False), bool), decode, first_control)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(learnt)
                now[4].update(learnt.encode())
                now[5] += chars
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(told(), kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

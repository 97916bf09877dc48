"""Chat formatting by a declarative template and a finite-state machine over the roles.

A template says how a turn is written, which roles are trained on, and which role may follow which.
Formatting a turn needs that turn alone: it yields one formatted string and its segments with a loss
flag each. The order of turns is checked on (conversation, turn, role) only: the rows are range
sorted, so a conversation of any length is spread over tasks; each task returns the machine's state
as a function of the state at its start, and these functions are composed across tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.session import materialize, ship_package


@dataclass(frozen=True)
class Template:
    """How conversations are written. Control strings start with ``opening``, which texts cannot
    contain once they are escaped."""

    head: str = "<|im_start|>{role}\n"
    tail: str = "<|im_end|>\n"
    opening: str = "<|"
    trained: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a role that is missing breaks the order for good.
    moves: Mapping[str, Mapping[str, str]] = None
    start: str = "start"
    #: States in which a conversation may end.
    ends: tuple[str, ...] = ("assistant", "user")


DEFAULT = Template(
    moves={
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    }
)
BROKEN = "broken"
SEGMENT = pa.struct([("text", pa.string()), ("loss", pa.bool_())])


def escape(text: str, opening: str) -> str:
    """Put one more backslash inside every (already escaped) opening; reversible."""
    first, second = re.escape(opening[0]), re.escape(opening[1:])
    return re.sub(rf"{first}(\\*){second}", lambda m: f"{opening[0]}{m[1]}\\{opening[1:]}", text)


def unescape(text: str, opening: str) -> str:
    first, second = re.escape(opening[0]), re.escape(opening[1:])
    return re.sub(rf"{first}(\\*)\\{second}", lambda m: f"{opening[0]}{m[1]}{opening[1:]}", text)


def segments(role: str | None, text: str | None, t: Template = DEFAULT) -> list[tuple[str, bool]]:
    """The segments of a turn with their loss flags. A null role or text is empty; a role's line
    breaks and backslashes are written as escapes."""
    name = escape((role or "").replace("\\", "\\\\").replace("\n", "\\n"), t.opening)
    head = t.head.format(role=name)
    return [(head, False), (escape(text or "", t.opening), role in t.trained), (t.tail, False)]


def parse_turn(formatted: str, t: Template = DEFAULT) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    before, after = t.head.split("{role}")
    if not formatted.startswith(before) or not formatted.endswith(t.tail):
        raise ValueError("not a formatted turn")
    cut = formatted.index(after, len(before))
    name = unescape(formatted[len(before) : cut], t.opening)
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name)
    return role, unescape(formatted[cut + len(after) : len(formatted) - len(t.tail)], t.opening)


def format_turns(turns: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """conv_id, turn, segments (array of text, loss): one row per row of ``turns``, no shuffle."""
    ship_package(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                [{"text": x, "loss": y} for x, y in segments(role.as_py(), text.as_py(), t)]
                for role, text in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.list_(SEGMENT))],
                names=["conv_id", "turn", "segments"],
            )

    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return plain.mapInArrow(run, "conv_id long, turn long, segments array<struct<text:string,loss:boolean>>")


def turn_order(turns: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """conv_id, valid: whether the roles follow the template's moves from its start to one of its
    ends. Rows with equal turn numbers are taken in the order of their roles, null turns last."""
    ship_package(turns.sparkSession)
    names = [*dict.fromkeys([t.start, *t.moves, *(s for m in t.moves.values() for s in m.values()), BROKEN])]
    number = {s: k for k, s in enumerate(names)}
    step = {
        role: [number[t.moves.get(s, {}).get(role, BROKEN)] for s in names]
        for role in {r for m in t.moves.values() for r in m}
    }
    lost = [number[BROKEN]] * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per conversation of the task: its part of the conversation as a state function."""
        part = TaskContext.get().partitionId()
        now, states, open_ = None, [], False
        for batch in batches:
            out: list[tuple] = []
            for conv, role in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not open_ or conv != now:
                    if open_:
                        out.append((now, part, states))
                    now, states, open_ = conv, list(range(len(names))), True
                moved = step.get(role, lost)
                states = [moved[s] for s in states]
            if out:
                yield rows(out)
        if open_:
            yield rows([(now, part, states)])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.int32()),
                pa.array([x[2] for x in out], pa.list_(pa.int32())),
            ],
            names=["conv_id", "part", "states"],
        )

    keys = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role")]
    parts = materialize(
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role")
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("conv_id", "role")
        .mapInArrow(run, "conv_id long, part int, states array<int>")
    )
    # at most one row per task and conversation
    composed = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "states"))).alias("parts"))
    final = F.aggregate("parts", F.lit(number[t.start]), lambda s, p: F.get(p["states"], s))
    return composed.select("conv_id", final.isin([number[s] for s in t.ends]).alias("valid"))


def read_back(formatted: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the output of
    :func:`format_turns` alone.

    Every turn is parsed from its formatted string, the loss text from the flagged segments. SHA-256
    is sequential, so a conversation's turns stream through one task in order; no more than a batch
    of them is held.
    """
    ship_package(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, False
        turns = loss = None
        n = loss_chars = chars = 0

        def row() -> pa.RecordBatch:
            values = [[now], [n], [turns.hexdigest()], [loss_chars], [loss.hexdigest()], [chars]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            for conv, parts in zip(batch.column(0), batch.column(1)):
                conv, parts = conv.as_py(), parts.as_py()
                if not open_ or conv != now:
                    if open_:
                        yield row()
                    now, open_ = conv, True
                    turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                whole = "".join(p["text"] for p in parts)
                role, text = parse_turn(whole, t)
                turns.update(f"{role}\n{text}\n".encode())
                learnt = "".join(unescape(p["text"], t.opening) for p in parts if p["loss"])
                loss.update(learnt.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(learnt), chars + len(whole)
        if open_:
            yield row()

    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "segments")
        .select("conv_id", "segments")
        .mapInArrow(
            run,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
        )
    )


def conversations(turns: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """The digest of all formatted conversations with ``valid`` from the turn order.

    ``turns`` has conv_id, turn, role, text; other columns are not read. Null ids are one
    conversation. Rows with equal turn numbers are ordered by what they say; rows that repeat stay.
    A conversation in wrong order is formatted all the same and marked not valid.
    """
    order = turn_order(turns, t).withColumnRenamed("conv_id", "_conv")
    digests = read_back(format_turns(turns, t), t)
    return digests.join(order, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")

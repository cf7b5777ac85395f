"""Chat formatting: a role automaton, a declarative template, and loss flags per segment.

A template names the marks; texts are escaped so that no mark can occur inside one,
and ``read_back`` recovers the turns from the formatted text alone. A conversation is
one output row, so one task holds one conversation, and never more, at a time.

Nulls: a null text or role is empty, a null turn number comes last, and rows without
``conv_id`` form one conversation. Rows with equal turn numbers are ordered by role,
then text; repeated rows stay. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """``headers``: what opens a turn of a role. ``trained``: roles whose text bears loss.

    ``moves`` maps (state, role) to the next state; the automaton begins in "start"
    and may end in one of ``final``.
    """

    headers: dict[str, str] = field(
        default_factory=lambda: {
            "system": "### System: ",
            "user": "### User: ",
            "assistant": "### Assistant: ",
            "tool": "### Tool: ",
        }
    )
    other: str = "### Other "
    end: str = "</turn>"
    trained: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
            ("assistant", "tool"): "tool",
            ("tool", "assistant"): "assistant",
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return [*self.headers.values(), self.other, self.end]

    def __post_init__(self):
        for mark in self.controls():
            if not mark or ESCAPE in mark:
                raise ValueError(f"a mark must not be empty or hold a backslash: {mark!r}")
            if any(mark.endswith(mark[:k]) for k in range(1, len(mark))):
                raise ValueError(f"a mark must not end as it begins: {mark!r}")
        for header in self.headers.values():
            if not header.endswith(": ") or ": " in header[:-2]:
                raise ValueError(f"a header holds ': ' once, at its end: {header!r}")


def _escape(text: Column, t: Template) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "b"))
    for i, mark in enumerate(t.controls()):
        text = F.replace(text, F.lit(mark), F.lit(f"{ESCAPE}{i};"))
    return text


def _unescape(text: Column, t: Template) -> Column:
    for i, mark in enumerate(t.controls()):
        text = F.replace(text, F.lit(f"{ESCAPE}{i};"), F.lit(mark))
    return F.replace(text, F.lit(ESCAPE + "b"), F.lit(ESCAPE))


def _literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _header(role: Column, t: Template) -> Column:
    name = F.replace(_escape(role, t), F.lit(":"), F.lit(ESCAPE + "c"))
    return F.coalesce(
        F.try_element_at(_literal_map(t.headers), role),
        F.concat(F.lit(t.other), name, F.lit(": ")),
    )


def _role(header: Column, t: Template) -> Column:
    name = F.substr(header, F.lit(len(t.other) + 1), F.length(header) - len(t.other) - 2)
    name = F.replace(name, F.lit(ESCAPE + "c"), F.lit(":"))
    known = _literal_map({h: r for r, h in t.headers.items()})
    return F.coalesce(F.try_element_at(known, header), _unescape(name, t))


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation: conv_id, n_turns, valid, first_bad (index of the first turn out of
    order, null if none), segments (text, loss), formatted.

    An invalid conversation is formatted like any other; callers filter on ``valid``.
    """
    t = template or Template()
    chats = (
        rows.select(
            "conv_id",
            F.struct(
                F.col("turn").isNull().alias("no_turn"),
                F.col("turn").alias("turn"),
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
            ).alias("row"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("row")).alias("turns"))
    )
    moves = _literal_map({f"{state}|{role}": to for (state, role), to in t.moves.items()})
    start = F.struct(
        F.lit("start").alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad")
    )

    def step(at, row):
        to = F.try_element_at(moves, F.concat(at.state, F.lit("|"), row.role))
        return F.struct(
            F.coalesce(to, F.lit("stuck")).alias("state"),
            (at.i + 1).alias("i"),
            F.coalesce(at.bad, F.when(to.isNull(), at.i)).alias("bad"),
        )

    def segments(row):
        def piece(text, loss):
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(
            piece(_header(row.role, t), F.lit(False)),
            piece(_escape(row.text, t), row.role.isin(*t.trained)),
            piece(F.lit(t.end + "\n"), F.lit(False)),
        )

    return (
        chats.withColumn("end", F.aggregate("turns", start, step))
        .withColumn("segments", F.flatten(F.transform("turns", segments)))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            (F.col("end.bad").isNull() & F.col("end.state").isin(*t.final)).alias("valid"),
            F.col("end.bad").alias("first_bad"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
        )
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) that a formatted text holds."""
    t = template or Template()
    pieces = F.split(formatted, rf"\Q{t.end}\E\n")

    def turn(piece):
        head = F.instr(piece, F.lit(": ")) + 1
        return F.struct(
            _role(F.substr(piece, F.lit(1), head), t).alias("role"),
            _unescape(F.substr(piece, head + 1), t).alias("text"),
        )

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    t = template or Template()
    trained = F.filter(segments, lambda s: s.loss)
    return F.array_join(F.transform(trained, lambda s: _unescape(s.text, t)), "")

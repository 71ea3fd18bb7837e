"""Chat formatting in budgeted windows.

Turn tokens are counted where the turns lie and prefix-summed for each
conversation; differences of the sums choose turn-aligned spans: a window takes
as many turns as its budget holds. Every window repeats the conversation's first system
turns and a limited history before its new turns. Assistant texts are under the
loss mask where they are new, and masked where they are repeated.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template. Any role has its own mark; texts can't hold a control string once they are escaped.
OPEN, CLOSE = {"user": "<s>[INST] ", "assistant": "<s>[/INST] ", "system": "<s><<SYS>> "}, " </s>"
OTHER = "<s>[ROLE {}] "
#: Control strings, with any number of escapes after the first character.
CONTROL = re.compile(r"([<\[])(\\*)(?=/?(?:s>|INST\]|ROLE |SYS>>))")
ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?(?:s>|INST\]|ROLE |SYS>>))")
#: Tokens of a window, and tokens of history that a window may repeat.
BUDGET, HISTORY = 1024, 256


def escape(text: str) -> str:
    r"""Put a backslash after the first character of every control string; one that has some gets one more."""
    return CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def mark(role: str) -> str:
    return OPEN.get(role) or OTHER.format(role.replace("\\", "\\\\").replace("]", "\\)"))


TURN = re.compile(r"<s>(?:\[(/?)INST\] |(<<SYS>> )|\[ROLE ((?:[^\]])*)\] )(.*?) </s>", re.S)


def read_turns(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn of a formatted window; start and end bound the escaped text."""
    out = []
    for m in TURN.finditer(window):
        if m[2]:
            role = "system"
        elif m[3] is not None:
            role = re.sub(r"\\(.)", lambda x: {"\\": "\\", ")": "]"}[x[1]], m[3])
        else:
            role = "assistant" if m[1] else "user"
        out.append((role, unescape(m[4]), m.start(4), m.end(4)))
    return out


def words_and_marks(text: str) -> int:
    """A token count that needs no vocabulary: words, and single characters that are neither words nor white space."""
    return len(re.findall(r"\w+|[^\w\s]", text))


WINDOWS = "conv_id long, window int, text string, spans array<struct<start:int,end:int>>, new_turns int, first_new int, tokens long, over_budget boolean"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
KINDS = [pa.int64(), pa.int32(), pa.string(), SPANS, pa.int32(), pa.int32(), pa.int64(), pa.bool_()]


class _Conversation:
    """Windows of one conversation, from its turns in order and their prefix sums; holds the turns of one window and its history."""

    def __init__(self, conv: int | None, budget: int, history: int) -> None:
        self.conv, self.budget, self.history = conv, budget, history
        self.system: list[str] = []  # formatted leading system turns
        self.past: list[str] = []  # formatted turns that may be repeated
        self.past_at: list[int] = []  # tokens of the conversation before each of them
        self.new: list[tuple[str, int, int]] = []  # formatted turn, target start and end
        self.new_at: list[int] = []
        self.window, self.upto, self.fixed, self.leading, self.leads = 0, 0, 0, True, 0

    def held(self, upto: int) -> int:
        """Tokens of a window that ends where the prefix sum is ``upto``."""
        return self.fixed + upto - (self.past_at or self.new_at or [self.upto])[0]

    def add(self, role: str, text: str, upto: int) -> Iterator[tuple]:
        body, opening = escape(text), mark(role)
        self.leading = self.leading and role == "system"
        # A further turn that doesn't fit opens the next window; the history shrinks to what the window's first turn leaves.
        if self.new and self.held(upto) > self.budget:
            yield self.close()
        if not self.new and self.held(upto) > self.budget:
            self.forget(upto + self.fixed - self.budget)
        target = (len(opening), len(opening) + len(body)) if role == "assistant" else (0, 0)
        self.new.append((opening + body + CLOSE, *target))
        self.new_at.append(self.upto)
        self.upto = upto
        self.leads += self.leading

    def forget(self, least: int) -> None:
        """Drop history that begins before the prefix sum is ``least``."""
        at = bisect_left(self.past_at, least)
        del self.past[:at], self.past_at[:at]

    def close(self) -> tuple:
        parts = self.system + self.past
        at, spans = sum(map(len, parts)), []
        for formatted, start, end in self.new:
            if end > start:
                spans.append({"start": at + start, "end": at + end})
            parts.append(formatted)
            at += len(formatted)
        tokens = self.held(self.upto)
        row = (self.conv, self.window, "".join(parts), spans, len(self.new), len(parts) - len(self.new), tokens, tokens > self.budget)
        # What follows repeats all leading system turns, whatever their length, and the latest turns that the history holds.
        turns = [x[0] for x in self.new]
        if self.leads:
            self.system += turns[: self.leads]
            self.fixed = self.new_at[self.leads] if self.leads < len(turns) else self.upto
        self.past += turns[self.leads :]
        self.past_at += self.new_at[self.leads :]
        self.forget(self.upto - self.history)
        self.window, self.new, self.new_at, self.leads = self.window + 1, [], [], 0
        return row


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[str], int] = words_and_marks) -> DataFrame:
    """A row for each window: conv_id, window, text, spans (under the loss mask), new_turns, first_new, tokens, over_budget.

    ``conversations`` needs conv_id, turn, role and text. Turns are taken by
    turn, nulls first, then role and text; a null text or role is empty; rows
    with a null conv_id are one conversation; repeated rows are turns of their
    own. A turn that is over the budget, alone or with the leading system turns
    that every window repeats, gets a window of its own, whole, and over_budget
    says so. Rows are streamed in order, so a conversation of any length needs
    no more memory than a window. An empty table gives an empty result; other
    columns are ignored.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            tokens = [count(mark(r) + escape(t) + CLOSE) for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], [*batch.schema.names, "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(KINDS)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "window", "text", "spans", "new_turns", "first_new", "tokens", "over_budget"])

        current: _Conversation | None = None
        for batch in batches:
            rows: list[tuple] = []
            for conv, known, role, text, upto in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                conv = conv if known else None
                if current is None or current.conv != conv:
                    if current is not None:
                        rows.append(current.close())
                    current = _Conversation(conv, budget, history)
                rows += current.add(role, text, upto)
            yield made(rows)
        if current is not None:
            yield made([current.close()])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNotNull().alias("known"), "turn", empty("role"), empty("text"))
    kind = rows.schema["turn"].dataType.simpleString()
    rows = rows.mapInArrow(counted, f"conv_id long, known boolean, turn {kind}, role string, text string, tokens long")
    # One exchange: the prefix sum's order by conversation is the one that the windows are cut in.
    order = Window.partitionBy("known", "conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("tokens").over(order))
    return summed.select("conv_id", "known", "role", "text", "upto").mapInArrow(run, WINDOWS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation say, read from their texts and spans alone, in order of their numbers.

    ``formatted`` has the columns of ``windows``, in any order of rows; windows
    with a null conv_id are one conversation; a repeated window is read twice;
    other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], pa.string() if i in (2, 4) else pa.int64()) for i in range(7)]
            return pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in DIGESTS.split(", ")])

        def row() -> tuple:
            return (conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"], state["windows"])

        for batch in batches:
            rows = []
            for c, text, spans, new, first in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if state is None or c != conv:
                    if state is not None:
                        rows.append(row())
                    conv, state = c, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "windows": 0}
                turns = read_turns(text)
                for role, body, _, _ in turns[first : first + new]:
                    state["turns"].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    state["n"] += 1
                for span in spans:
                    target = unescape(text[span["start"] : span["end"]])
                    state["loss"].update(target.encode("utf-8", "surrogatepass"))
                    state["chars"] += len(target)
                state["all"] += len(text)
                state["windows"] += 1
            yield made(rows)
        if state is not None:
            yield made([row()])

    placed = formatted.select("conv_id", "text", "spans", "new_turns", "first_new", "window").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return placed.drop("window").mapInArrow(run, DIGESTS)

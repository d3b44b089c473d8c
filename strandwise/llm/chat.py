"""Chat formatting in budgeted windows.

A conversation's rows are taken by turn. Prefix sums of turn sizes (words `[^\x20\x09-\x0D]+`, plus one a turn) choose
turn-aligned spans: a window ends before the turn with which it would exceed `budget`, what it repeats included. Each
window repeats the first system turn and up to `history` turns before it, as far as they fit in `history_budget` and
leave room for its first own turn; their targets are masked, so every assistant text is a target once. A window exceeds
the budget only if a turn and the system turn do so by themselves.

Template: [SYS]..[/SYS], [INST]..[/INST], [ANS]..[/ANS], and [ROLE x]..[/ROLE] for other roles, x escaped too. In
texts a backslash stands before each backslash, [ and <, so control strings in a text are never read as such, and
reading back gives the text exactly.

Rows come sorted by conversation and turn and are formatted as a stream: no conversation is ever held whole.

Defined results: a null text or role is empty; ties of turn go by role, then text; repeated rows are turns of their
own; a null conv_id is a conversation; null turns come first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = {"system": "SYS", "user": "INST", "assistant": "ANS"}
ROLES = {v: k for k, v in TAGS.items()}
_SPECIAL = re.compile(r"([\\\[<])")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"\[(SYS|INST|ANS|ROLE (?:[^\\\]]|\\.)*)\]((?:[^\\\[]|\\.)*)\[/(?:SYS|INST|ANS|ROLE)\]", re.S)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOWS = "conv_id long, window long, text string, loss array<struct<start:long,length:long>>, repeated long"


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and length of its escaped text)."""
    tag = TAGS.get(role)
    head, tail = (f"[{tag}]", f"[/{tag}]") if tag else (f"[ROLE {escape(role).replace(']', chr(92) + ']')}]", "[/ROLE]")
    body = escape(text)
    return head + body + tail, len(head), len(body)


def read_turns(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn of a formatted window."""
    found, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        head = m.group(1)
        found.append((ROLES[head] if head in ROLES else unescape(head[5:]), unescape(m.group(2)), m.start(2), m.end(2)))
        at = m.end()
    return found


class _Window:
    """Formats turns one after the other."""

    def __init__(self, conv, number, repeated):
        self.conv, self.number, self.repeated = conv, number, len(repeated)
        self.parts, self.length, self.loss = [], 0, []
        for role, text in repeated:
            self.add(role, text, False)

    def add(self, role: str, text: str, target: bool) -> None:
        part, start, length = format_turn(role, text)
        if target:
            self.loss.append({"start": self.length + start, "length": length})
        self.parts.append(part)
        self.length += len(part)

    def row(self) -> tuple:
        return self.conv, self.number, "".join(self.parts), self.loss, self.repeated


def words(text: str) -> int:
    return sum(1 for _ in _WORD.finditer(text))


def windows_of(rows, budget: int, history: int, history_budget: int):
    """Window rows of (conv_id, role, text) rows that come by conversation and turn."""
    none = object()
    conv, window = none, None
    for c, role, text in rows:
        role, text = role or "", text or ""
        if c != conv or window is None:
            if window is not None:
                yield window.row()
            conv, before, first, system, recent, window = c, 0, 0, None, [], None
        size = words(text) + 1
        if window is None or before + size - first > budget:
            if window is not None:
                yield window.row()
            held = words(system) + 1 if system is not None else 0
            kept, room = [], min(history_budget, budget - held - size)
            for n, r, t in reversed(recent):
                if (system is not None and r == "system" and t == system) or n > room:
                    break
                room -= n
                held += n
                kept.append((r, t))
            window = _Window(c, 0 if window is None else window.number + 1, ([("system", system)] if system is not None else []) + kept[::-1])
            first = before - held
        window.add(role, text, role == "assistant")
        if role == "system" and system is None:
            system = text
        recent = [*recent, (size, role, text)][-history:] if history else []
        before += size
    if window is not None:
        yield window.row()


def chat_windows(conversations: DataFrame, budget: int = 2048, history: int = 4, history_budget: int = 512) -> DataFrame:
    """conv_id, window, text, loss, repeated (turns at the start that an earlier window has); by conversation, in order.

    One shuffle, by conversation; within a partition rows are sorted with spilling and streamed.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        def each():
            for b in batches:
                yield from zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist())

        held, size = [], 0
        for row in windows_of(each(), budget, history, history_budget):
            held.append(row)
            size += len(row[2])
            if size > 1 << 20:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    return rows.select("conv_id", "role", "text").mapInArrow(run, WINDOWS)


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, number, text, loss, repeated = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(number, pa.int64()), pa.array(text, pa.string()), pa.array(loss, _LOSS), pa.array(repeated, pa.int64())], names=["conv_id", "window", "text", "loss", "repeated"])


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of conversations, read from their windows alone, which must come in order within a partition."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def run(batches):
        none = object()
        conv, rows, n = none, [], None
        turns = loss = None
        for b in batches:
            for c, text, spans, repeated in zip(b.column("conv_id").to_pylist(), b.column("text").to_pylist(), b.column("loss").to_pylist(), b.column("repeated").to_pylist()):
                if c != conv or n is None:
                    if n is not None:
                        rows.append((conv, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2], n[3]))
                    conv, n, turns, loss = c, [0, 0, 0, 0], sha256(), sha256()
                for role, said, _, _ in read_turns(text)[repeated:]:
                    n[0] += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["start"] : span["start"] + span["length"]])
                    n[1] += len(said)
                    loss.update(said.encode())
                n[2] += len(text)
                n[3] += 1
            if len(rows) > 4096:
                yield _digest_batch(rows)
                rows = []
        if n is not None:
            rows.append((conv, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2], n[3]))
        if rows:
            yield _digest_batch(rows)

    return windows.mapInArrow(run, schema)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(chat_windows(rows))

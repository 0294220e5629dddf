r"""Chat formatting with a grammar that reads back what was written.

A turn is written as `### Label: text</turn>` and a line break. The control strings are the end
mark `</turn>` and the headers `### Label: `. Inside a text, a control string (or the end of the
text) that follows m backslashes is written with 2m of them, and a control string with one more;
reading halves them. A header or end mark after an odd number of backslashes is therefore text.

Each turn is first rendered as it is, parsed, and compared with its source; as long as the parsed
text differs, the conflicting places are escaped and the turn is rendered again. A turn is a
complete sentence of the grammar, so turns of a conversation can be written, checked and read one
by one, in any task; the conversation is their concatenation by turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from throughline.llm.frames import ship

#: Roles with a label of their own; any other role is written as `Role ` and its escaped name.
LABELS = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
ROLES = {label: role for role, label in LABELS.items()}
END = "</turn>"
HEADER = r"### (?:System|User|Assistant|Tool|Role [^:\n]*): "
CONTROL = re.compile(rf"(\\*)({HEADER}|{END}|\Z)")
FIRST = re.compile(HEADER)


def label(role: str) -> str:
    """The header's name of a role: reversible, without colons or line breaks."""
    return LABELS.get(role) or "Role " + role.replace("%", "%25").replace(":", "%3A").replace("\n", "%0A")


def role_of(name: str) -> str:
    return ROLES.get(name) or name[5:].replace("%0A", "\n").replace("%3A", ":").replace("%25", "%")


def escaped(text: str) -> str:
    """Every control string marked as text."""
    return CONTROL.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation; ValueError if it is not in the grammar."""
    at = 0
    while at < len(formatted):
        head = FIRST.match(formatted, at)
        if not head:
            raise ValueError(f"no header at {at}")
        at, text = head.end(), []
        for m in CONTROL.finditer(formatted, at):
            if not m[2]:
                raise ValueError(f"no end mark after {at}")
            text += formatted[at:m.start()], "\\" * (len(m[1]) // 2)
            at = m.end()
            if len(m[1]) % 2:
                text.append(m[2])
            elif m[2] == END:
                break
            else:
                raise ValueError(f"a header inside the turn at {m.start()}")
        if formatted[at:at + 1] != "\n":
            raise ValueError(f"no line break at {at}")
        at += 1
        yield role_of(head[0][4:-2]), "".join(text)


def render(role: str, text: str) -> tuple[str, int]:
    """A turn that reads back as its source, and how often it had to be escaped."""
    source, body = [(role, text)], text
    for rounds in range(3):
        formatted = f"### {label(role)}: {body}{END}\n"
        try:
            if list(parse(formatted)) == source:
                return formatted, rounds
        except ValueError:
            pass
        body = escaped(text)
    raise AssertionError("the grammar does not read back its own escapes")


def format_turns(df: DataFrame, role: str = "role", text: str = "text", out: str = "formatted") -> DataFrame:
    """`df` with each turn rendered and verified; a conversation's format is their concatenation by turn.

    A null role or text counts as empty. Repeated turns stay. A column with the name of the new
    one is replaced.
    """
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def rendered(roles: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([render(r or "", t or "")[0] for r, t in zip(roles, bodies, strict=True)], dtype=object)

    return df.withColumn(out, rendered(F.col(role), F.col(text)))


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long")


class _Reader:
    """Reads one conversation's turns as they come; it keeps digests, never the texts."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss = conv, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def take(self, formatted: str) -> None:
        for role, text in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss += len(text)
                self.masked.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return (self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars)


def digests(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", formatted: str = "formatted") -> DataFrame:
    """Per conversation, what its format says when it is read back; the loss mask covers assistant texts.

    Turns are dealt out and sorted by conversation and turn (ties: by the format itself) and
    then streamed, so that a conversation of any length takes constant memory. Its digest is one
    chain of hash states, so its turns do pass through one task, in order.
    """
    ship(turns.sparkSession)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
                         F.col(formatted).alias("formatted"))
            .repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "formatted"))

    def table(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(
            (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=[c.split()[0] for c in DIGEST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv_id, text in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
                if now is None or now.conv != conv_id:
                    if now:
                        done.append(now.row())
                    now = _Reader(conv_id)
                now.take(text)
            yield table(done)
            done = []
        if now:
            yield table([now.row()])

    return rows.mapInArrow(run, DIGEST)

"""Repair of the structure of conversations over a suffix-shared automaton.

A turn of a conversation counts as one letter: its role's first letter as far as the grammar knows
it, capital if the text is cut off, or x if the turn has to go. The words of all conversations are
minimised from their ends: equal rests of two words are one node, whose only way on is its first
letter and the node of the rest after it. What is cheapest from a node to the end depends on the
node and on the state of the grammar alone, so it is worked out once for both, from the next
node's: the cost, and the first edit with its place to go on, which together are the best rest of
the audit. Distinct words are sorted by their reversed letters and dealt out by range, so that a
task meets each of its nodes once, on a path that it keeps from the end; only the nodes on a path
to a border between two ranges are worked out on either side.

The grammar is `(s?(ua)+)?`. Its states: START, SYSTEM (after s), USER (after u), ANSWER (after a).
In each of them exactly one of user and assistant may come next, so an audit of edits says which
role a turn was given.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from throughline.llm.frames import ship, stage

START, SYSTEM, USER, ANSWER = range(4)
#: The state after the one role that may be inserted or given in each state.
GIVEN = (USER, USER, ANSWER, USER)
#: The state after a kept turn with a role's first letter.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ANSWER: USER}, "a": {USER: ANSWER}, "o": {}}
#: What the edits cost, and a turn that stays although it is cut off.
DELETE, GIVE, INSERT, CUT_OFF = 3, 2, 2, 1
#: Costs at the end of a conversation: nothing, or the turns that have to be inserted.
END = (0, 2 * INSERT, INSERT, 0)
#: White space; a text of nothing else is blank.
SPACES = " \t\n\x0b\x0c\r"
#: Distinct words that share of all conversations or more are joined by broadcast: at most so many, each at most so long.
FREQUENT, LONGEST = 1000, 4096
#: Letters of distinct words that a task is meant to hold.
RANGE = 8 << 20


@lru_cache(1 << 16)
def _step(letter: str, rest: tuple[int, ...]) -> tuple[tuple[int, ...], bytes]:
    """A node's costs and first edits by state, from its letter and the costs of the node after it.

    Of edits that cost the same the one with the least letter is first in the audit: D, I, K, R.
    """
    must, late = letter == "x", CUT_OFF if letter.isupper() else 0
    turns = []
    for state in range(4):
        found = [(DELETE + rest[state], "D")]
        if not must:
            after = KEPT[letter.lower()].get(state)
            if after is not None:
                found.append((late + rest[after], "K"))
            found.append((GIVE + late + rest[GIVEN[state]], "R"))
        turns.append(min(found))
    # At most one turn is worth inserting before this one in USER and ANSWER, two in the others.
    costs = [turns[s][0] for s in range(4)]
    costs[USER], costs[ANSWER] = min(costs[USER], INSERT + costs[ANSWER]), min(costs[ANSWER], INSERT + costs[USER])
    for state in (START, SYSTEM):
        costs[state] = min(costs[state], INSERT + costs[USER])
    edits = bytes(ord(min(([turns[s][1]] if turns[s][0] == costs[s] else []) + (["I"] if INSERT + costs[GIVEN[s]] == costs[s] else [])))
                  for s in range(4))
    return tuple(costs), edits


class Path:
    """The nodes from the end to the one at hand: their letters, costs and first edits by state."""

    def __init__(self):
        self.letters, self.made = "", 0
        self.costs = [array("q", [c]) for c in END]
        self.edits = [bytearray(e) for e in (b".", b"I", b"I", b".")]

    def go(self, word: str) -> None:
        """Go to the node of a reversed word; nodes it shares with the one before are there already."""
        same, top = 0, min(len(word), len(self.letters))
        while same < top and word[same:same + 64] == self.letters[same:same + 64]:
            same = min(same + 64, top)
        while same < top and word[same] == self.letters[same]:
            same += 1
        for column in (*self.costs, *self.edits):
            del column[same + 1:]
        now = tuple(column[same] for column in self.costs)
        for letter in word[same:]:
            base = min(now)
            step, edits = _step(letter, tuple(c - base for c in now))
            now = tuple(c + base for c in step)
            for state in range(4):
                self.costs[state].append(now[state])
                self.edits[state].append(edits[state])
        self.made += len(word) - same
        self.letters = word

    def answer(self) -> tuple[int, str]:
        """The least cost of the conversation at hand and its audit."""
        state, at, audit = START, len(self.letters), bytearray()
        while (edit := self.edits[state][at]) != 46:
            audit.append(edit)
            if edit == 75:
                state = KEPT[self.letters[at - 1].lower()][state]
            elif edit != 68:
                state = GIVEN[state]
            at -= edit != 73
        return self.costs[START][-1], audit.decode()


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copy): turns harmed by crc32 of `conv:turn` modulo 20.

    0 drops the turn (it stays as copy 0, which stands for its conversation only), 1 empties its text, 2 takes the
    marks `.!?` out of it, 3 repeats it (copies 1 and 2), 4 makes it the user's. A null in any column is
    one space in texts made of it; conversations and turns that are null stay so.
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    harm = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")) % 20
    return df.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(harm == 4, "user").otherwise(spaced[2]).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(spaced[3], ".!?", "")).otherwise(spaced[3]).alias("text"),
        F.explode(F.when(harm == 0, F.array(F.lit(0))).when(harm == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))


def _digest() -> Column:
    """Of role and text; turns of the same number are in its order."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))


WORDS = "conv_id long, word string, gaps long, blank long, duplicate long, truncated long, illegal long"
LEGAL = {"su", "ua", "au"}


class _Reader:
    """A conversation's word and counts, turn by turn."""

    def __init__(self, conv):
        self.conv, self.word = conv, []
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def take(self, turn, initial: str, fault: str | None) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.last = initial
        if fault:
            self.faults[fault] += 1
        letter = "x" if fault in ("blank", "duplicate") else initial if initial in ("s", "u", "a") else "o"
        self.word.append(letter.upper() if fault == "truncated" else letter)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, "".join(self.word), gaps, *self.faults.values(), self.illegal)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string()] + [pa.int64()] * 5
    names = [c.split()[0] for c in WORDS.split(", ")]
    now: _Reader | None = None
    for batch in batches:
        done = []
        for conv, turn, initial, fault, copy in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "copy")), strict=True):
            if now is None or now.conv != conv:
                if now:
                    done.append(now.row())
                now = _Reader(conv)
            if copy:
                now.take(turn, initial, fault)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(now.row(), kinds, strict=True)], names=names)


def words(turns: DataFrame) -> DataFrame:
    """Each conversation's word and its counts of gaps, first faults and illegal neighbours.

    Narrow rows (no text) are dealt out and sorted by conversation; a conversation passes through one task, turn by turn.
    """
    ship(turns.sparkSession)
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    narrow = turns.select("conv_id", "turn", "copy", F.substring("role", 1, 1).alias("initial"), _digest().alias("digest"),
                          (F.length(shown) == 0).alias("blank"), F.substring(shown, -1, 1).isin(".", "!", "?").alias("whole"))
    once = Window.partitionBy("conv_id", "digest").orderBy(F.col("copy") == 0, "turn", "copy")
    rows = (narrow.repartition("conv_id").withColumn("again", F.row_number().over(once) > 1)
            .select("conv_id", "turn", "digest", "copy", "initial",
                    F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(~F.col("whole"), "truncated").alias("fault"))
            .sortWithinPartitions("conv_id", "turn", "digest", "copy"))
    return rows.mapInArrow(_read, WORDS)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = Path()
    for batch in batches:
        found = []
        for reverse in batch.column("reverse").to_pylist():
            path.go(reverse)
            found.append(path.answer())
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array([c for c, _ in found], pa.int64()),
                                          pa.array([a for _, a in found], pa.string())], names=["word", "n", "cost", "audit"])


def solve(found: DataFrame) -> DataFrame:
    """(word, n, cost, audit) of each distinct word of `found`; n conversations have it."""
    distinct = stage(found.groupBy("word").agg(F.count("*").alias("n")).withColumn("reverse", F.reverse("word")), "repair-distinct")
    size = distinct.agg(F.coalesce(F.sum(F.length("word") + 32), F.lit(0)).alias("b")).first().b
    return (distinct.repartitionByRange(1 + size // RANGE, "reverse").sortWithinPartitions("reverse")
            .mapInArrow(_solve, "word string, n long, cost long, audit string"))


def answers(turns: DataFrame) -> DataFrame:
    """Each conversation's counts, least cost and audit.

    Words that a thousandth or more of all conversations have are at most a thousand, and join by broadcast; all others are joined by a shuffle.
    """
    found = stage(words(turns), "repair-words")
    solved = stage(solve(found), "repair-solved")
    total = solved.agg(F.sum("n").alias("t")).first().t or 0
    often = (F.col("n") * FREQUENT >= total) & (F.length("word") <= LONGEST)
    known = F.broadcast(solved.filter(often).drop("n"))
    rare = found.join(known.select("word"), "word", "left_anti").join(solved.filter(~often).drop("n"), "word")
    return stage(found.join(known, "word").unionByName(rare), "repair-answers")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPAIRED = "conv_id long, place long, role string, text string, edit string, audit string, " + ", ".join(f"{c} long" for c in COUNTS)
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()] + [pa.int64()] * len(COUNTS)
_NAMES = [c.split()[0] for c in REPAIRED.split(", ")]


class _Editor:
    """Applies one conversation's audit to its turns as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.state = audit, 0, 0, START

    def _given(self, text: str, edit: str) -> tuple:
        self.state = GIVEN[self.state]
        self.place += 1
        return (self.place, "user" if self.state == USER else "assistant", text, edit)

    def insert(self) -> Iterator[tuple]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._given("", "I")

    def take(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._given(text, edit)
        elif edit == "K":
            self.state = KEPT[role[:1]][self.state]
            self.place += 1
            yield (self.place, role, text, edit)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    editor = conv = None
    for batch in batches:
        done: list[tuple] = []
        counts = list(zip(*(batch.column(c).to_pylist() for c in ["audit", *COUNTS]), strict=True))
        for i, (c, copy, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "copy", "role", "text")), strict=True)):
            if copy is None:  # the first row of a conversation holds its audit
                if editor:
                    done += [(conv, *t, *[None] * 7) for t in editor.insert()]
                conv, editor = c, _Editor(counts[i][0])
                done.append((conv, 0, None, None, None, *counts[i]))
            elif copy:
                done += [(conv, *t, *[None] * 7) for t in editor.take(role, text)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(_KINDS)], names=_NAMES)
    if editor:
        done = [(conv, *t, *[None] * 7) for t in editor.insert()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(_KINDS)], names=_NAMES)


def repair(turns: DataFrame) -> DataFrame:
    """Every conversation of `turns` (conv_id, turn, role, text and copy, as `damage` gives them) repaired at the least cost.

    Place 0 of a conversation holds its audit, cost and counts; places from 1 on its turns after the repair and
    the edit each comes from (K, R or I). Rows of a conversation are in the order of their places and
    next to each other in one partition. Turns are ordered by number, null first; of the same number by a
    digest of role and text. Role and text must not be null; a copy of 0 stands for its conversation only.
    """
    ship(turns.sparkSession)
    heads = answers(turns).drop("word")
    rows = turns.withColumn("digest", _digest()).unionByName(heads, allowMissingColumns=True)
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("copy").isNotNull(), "turn", "digest", "copy")
            .mapInArrow(_edit, REPAIRED))


REPORT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * (1 + len(COUNTS)) + [pa.string()] * 2
    names = [c.split()[0] for c in REPORT.split(", ")]
    head = digest = None
    for batch in batches:
        done = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("place", "role", "text", "conv_id", *COUNTS, "audit")), strict=True)
        for place, role, text, *rest in rows:
            if place == 0:
                if head:
                    done.append((*head, digest.hexdigest()))
                head, digest = rest, hashlib.sha256()
            else:
                digest.update((f"{role}:{text}" if place == 1 else f"\n{role}:{text}").encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
    if head:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*head, digest.hexdigest()), kinds, strict=True)], names=names)


def report(repaired: DataFrame) -> DataFrame:
    """One row of each conversation of `repair`: its counts, cost, audit, and a digest of its turns `role:text`, joined by line breaks."""
    return repaired.mapInArrow(_report, REPORT)

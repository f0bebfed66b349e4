"""Conversation structure repair: the cheapest edits that give a conversation the turns it should have.

A conversation's role initials must read ``(s?(ua)+)?``: nothing, or an optional system turn and then user and assistant in turn. Edits: Keep costs
nothing, Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or assistant turn, anywhere) 3; a truncated row that is not deleted
adds 3; blank rows and rows that repeat an earlier one must be deleted. The audit is the initials of the edits in order; of the cheapest ones the
least in ASCII counts.

Rows are brought together by conversation once and sorted by turn; a task then reads its partition as a stream of Arrow batches. The
four states of the pattern (nothing yet, after system, after user, after assistant) hold the cost of the best edits so far, the rank of
their audit among the four, and a running SHA-256 of the text that they give, so a conversation's rows are never held. One byte for each state and row says
where the best edits came from; beyond ``spill_bytes`` these bytes go to a file of the task (unlinked, and written again by
a task that is tried again), from which the audit is read backwards. Ranks suffice for ties: every audit of i rows ends with the edit of row i, so no
best audit is the beginning of another one. Costs and ranks relative to each other take few values, so a step is looked up after it was worked out once.

A conversation is one stream in one task, as its edits depend on all that went before; the task's memory does not grow with it
(Spark's sorts spill). Everything before (faults, repeats) is made of built-in functions on the same partitioning.

Defined results: null role or text is one space, a null turn comes first, a null id is a conversation of its own; rows of one turn are ordered by role and text;
rows repeated in full are duplicates; a conversation without rows has zeros, an empty audit and the hash of the empty text; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. Where an inserted or reroled turn leads.
_ALTERNATE = (2, 2, 3, 2)
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ENDS = (0, 3)
_LETTERS = "DIKR"
_NONE = 255


def conversation_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with nulls as one space."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def damage(rows: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of ``conv_id:turn`` gives them, and ``present``: false for rows that are dropped (their conversation is still known)."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(key) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).when(fault == 0, "").otherwise(F.col("text"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (fault != 0).alias("present"), F.explode(copies).alias("copy")).drop("copy")


def _last_mark(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))


def _sorted_with_faults(rows: DataFrame) -> DataFrame:
    """Rows hashed by conversation and sorted by turn, with each row's first fault (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    dealt = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "present", "role", F.md5("text")).orderBy(F.asc_nulls_first("turn"))
    seen = dealt.withColumn("nth", F.row_number().over(same))
    last = _last_mark(F.col("text"))
    fault = F.when(last == "", 1).when(F.col("nth") > 1, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return seen.select("conv_id", "turn", "role", "text", "present", fault.alias("fault")).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


def _without_nulls(name: str) -> list[Column]:
    """A number and whether it is known: pandas would turn a column with nulls into floating point."""
    return [F.coalesce(F.col(name), F.lit(0)).alias(name), F.col(name).isNotNull().alias(f"{name}_known")]


@lru_cache(maxsize=1 << 16)
def _step(state: tuple, initial: str, fault: int) -> tuple[tuple, int, tuple[int, ...]]:
    """One row: (costs and ranks after it, what is added to all costs, a backpointer for each state).

    ``state`` holds a (cost, rank) or None for each state, costs relative to the least. A backpointer is the state before, the number of inserts and the edit's letter.
    """
    best: list[tuple | None] = [None] * 4
    for before, held in enumerate(state):
        if held is None:
            continue
        cost, rank = held
        now = before
        for inserts in range(3):
            edits = [("D", now, DELETE)]
            if fault not in (1, 2):
                more = CUT_OFF if fault == 3 else 0
                edits.append(("R", _ALTERNATE[now], REROLE + more))
                if now in _KEPT.get(initial, ()):
                    edits.append(("K", _KEPT[initial][now], KEEP + more))
            for letter, after, price in edits:
                found = (cost + INSERT * inserts + price, rank, "I" * inserts + letter, before | inserts << 2 | _LETTERS.index(letter) << 4)
                if best[after] is None or found < best[after]:
                    best[after] = found
            now = _ALTERNATE[now]
    least = min(b[0] for b in best if b)
    order = sorted(b[1:3] for b in best if b)
    after = tuple(None if b is None else (b[0] - least, order.index(b[1:3])) for b in best)
    return after, least, tuple(_NONE if b is None else b[3] for b in best)


def _turn(state: int) -> tuple[bytes, int]:
    """What an empty or reroled turn writes before its text in this state, and the state after it."""
    after = _ALTERNATE[state]
    return (b"\n" if state else b"") + (b"user:" if after == 2 else b"assistant:"), after


class _Backpointers:
    """Four bytes a row, in memory up to a bound and in an unlinked file beyond it."""

    def __init__(self, spill_bytes: int):
        self.limit, self.held, self.file = spill_bytes, bytearray(), None

    def add(self, row: tuple[int, ...]) -> None:
        self.held += bytes(row)
        if len(self.held) >= self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.held)
            self.held.clear()

    def backwards(self) -> Iterator[memoryview]:
        """Blocks of rows, the last block first."""
        yield memoryview(bytes(self.held))
        if self.file:
            at = self.file.tell()
            while at:
                size = min(at, self.limit - self.limit % 4)
                at -= size
                self.file.seek(at)
                yield memoryview(self.file.read(size))
            self.file.close()


class _Conversation:
    def __init__(self, conv_id, spill_bytes: int):
        self.conv_id, self.before = conv_id, None
        self.state: tuple = ((0, 0), None, None, None)
        self.cost, self.back = 0, _Backpointers(spill_bytes)
        self.hashes = [hashlib.sha256(), None, None, None]
        self.counts = [0, 0, 0, 0]
        self.illegal = self.distinct = 0
        self.first = self.last = None

    def add(self, turn, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.counts[fault] += 1
        self.state, more, back = _step(self.state, initial if initial in _KEPT else "", fault)
        self.cost += more
        self.back.add(back)
        data = text.encode("utf-8", "surrogatepass")
        hashes = []
        for pointer in back:
            if pointer == _NONE:
                hashes.append(None)
                continue
            now, inserts, letter = pointer & 3, pointer >> 2 & 3, _LETTERS[pointer >> 4]
            h = self.hashes[now].copy()
            for _ in range(inserts):
                written, now = _turn(now)
                h.update(written)
            if letter == "R":
                h.update(_turn(now)[0] + data)
            elif letter == "K":
                h.update((b"\n" if now else b"") + role.encode("utf-8", "surrogatepass") + b":" + data)
            hashes.append(h)
        self.hashes = hashes

    def report(self) -> tuple:
        ends = []
        for n, held in enumerate(self.state):
            if held:
                now, inserts = n, 0
                while now not in _ENDS:
                    now, inserts = _ALTERNATE[now], inserts + 1
                ends.append((held[0] + INSERT * inserts, held[1], n, inserts))
        more, _, now, inserts = min(ends)
        h, state = self.hashes[now].copy(), now
        for _ in range(inserts):
            written, state = _turn(state)
            h.update(written)
        letters = bytearray(b"I" * inserts)
        for block in self.back.backwards():
            for at in range(len(block) - 4, -1, -4):
                pointer = block[at + now]
                letters.append(ord(_LETTERS[pointer >> 4]))
                letters += b"I" * (pointer >> 2 & 3)
                now = pointer & 3
        letters.reverse()
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, self.cost + more, letters.decode(), h.hexdigest())


def _stream(spill_bytes: int):
    columns = [c.split()[0] for c in REPORT.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        values = dict(zip(columns, zip(*rows))) if rows else {c: () for c in columns}
        return pd.DataFrame({c: pd.array(list(v), dtype="Int64") if n < 7 else list(v) for n, (c, v) in enumerate(values.items())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, done, size = None, [], 0
        for b in batches:
            for conv_id, known, turn, has_turn, role, text, present, fault in zip(*(b[c].tolist() for c in b.columns)):
                conv_id = conv_id if known else None
                if open_ is None or open_.conv_id != conv_id:
                    if open_:
                        done.append(open_.report())
                        size += len(done[-1][7]) + 200
                    open_ = _Conversation(conv_id, spill_bytes)
                if present:
                    open_.add(turn if has_turn else None, role, text, fault)
                if size > 1 << 22:
                    yield frame(done)
                    done, size = [], 0
        if open_:
            done.append(open_.report())
        yield frame(done)

    return run


def repair(rows: DataFrame, spill_bytes: int = 4 << 20) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text; ``present`` false marks rows that only name their conversation): faults, cost, audit and the hash of the repaired text."""
    if "present" not in rows.columns:
        rows = rows.withColumn("present", F.lit(True))
    streamed = _sorted_with_faults(rows).select(*_without_nulls("conv_id"), *_without_nulls("turn"), "role", "text", "present", "fault")
    return streamed.mapInPandas(_stream(max(4, spill_bytes - spill_bytes % 4)), REPORT)


def repaired_rows(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit) of the conversations after the edits of ``report``, made of built-in functions; a join on the conversation and the row's number."""
    present = rows.where("present") if "present" in rows.columns else rows
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    numbered = present.select("conv_id", "role", "text", (F.row_number().over(order) - 1).alias("row"))
    blocks = report.select("conv_id", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[DKR]|I+$"), F.lit(0))).alias("row", "block")).select(F.col("conv_id").alias("of"), F.col("row").alias("nth"), "block")
    met = numbered.join(blocks, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("nth")), "right")
    steps = met.select(F.col("of").alias("conv_id"), F.col("nth").alias("row"), "role", "text", F.posexplode(F.split("block", "")).alias("k", "edit")).where("edit NOT IN ('D', '')")
    place = Window.partitionBy("conv_id").orderBy("row", "k")
    placed = steps.withColumn("position", F.row_number().over(place)).withColumn("system", F.first(F.when((F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(place))
    by_place = F.when((F.col("position") - F.col("system")) % 2 == 1, "user").otherwise("assistant")
    return placed.select("conv_id", "position", F.when(F.col("edit") == "K", F.col("role")).otherwise(by_place).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit")

"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

1. Rows go to their conversation's task, where a window marks texts that the same role has
   said before, and are sorted by turn.
2. Each task reads its conversations as one ordered stream of Arrow batches and parses them
   with `role_stacks`: only the live stacks, their running digests and the audit are held, not
   the rows. A conversation of any length takes bounded memory beside its audit.
3. The digest of the repaired text is carried along each stack.

A conversation is one stream, however long, since a SHA-256 digest can't be merged from parts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sarani.llm.common import as_bytes
from sarani.llm.role_stacks import Repair, Repairer

BLANKS = b" \t\n\x0b\x0c\r"
FULL_STOPS = (b".", b"!", b"?")
LEGAL_PAIRS = ("su", "ua", "au")
ROLES = {"u": b"user", "a": b"assistant"}
LONG = 2**63 - 1
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, times: the rows with planted faults, chosen by crc32 of
    `conv_id:turn` mod 20: 0 drops the row (times 0), 1 empties its text, 2 takes out its full
    stops, 3 repeats it (times 2), 4 makes it the user's. Nulls are one blank, in the hash too."""
    blank = F.lit(" ")
    spot = F.concat(F.coalesce(F.col(key).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    fault = F.crc32(spot.cast("binary")) % 20
    said = F.coalesce(F.col(text).cast("string"), blank)
    return rows.select(
        F.col(key).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(F.coalesce(F.col(role).cast("string"), blank)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"),
    )


@functools.lru_cache(maxsize=1)
def repairer() -> Repairer:
    return Repairer()


def write_digest(written: tuple, edit: str, symbol: str, row: tuple[bytes, bytes]) -> tuple:
    """The digest of the repaired rows so far, each `role:text`, with one more."""
    digest, started = written
    digest = digest.copy()
    role, text = (ROLES[symbol], b"") if edit == "I" else (ROLES[symbol] if edit == "R" else row[0], row[1])
    digest.update((b"\n" if started else b"") + role + b":" + text)
    return digest, True


def write_rows(written: tuple | None, edit: str, symbol: str, row: tuple[bytes, bytes]) -> tuple:
    """The repaired rows so far as a chain, with one more."""
    role, text = (ROLES[symbol], b"") if edit == "I" else (ROLES[symbol] if edit == "R" else row[0], row[1])
    return written, role + b":" + text


class Reading:
    """One conversation, read row by row."""

    def __init__(self, conv, with_text: bool):
        self.conv, self.with_text = conv, with_text
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None
        self.repair = Repair(repairer(), write_rows, None) if with_text else Repair(repairer(), write_digest, (hashlib.sha256(), False))

    def add(self, turn: int | None, role: bytes, text: bytes, seen: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        initial = role.decode()[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL_PAIRS
        self.before = initial
        said = text.strip(BLANKS)
        cut = bool(said) and not seen and not said.endswith(FULL_STOPS)
        self.blank += not said
        self.duplicate += bool(said) and seen
        self.truncated += cut
        self.repair.add(initial, seen or not said, cut, (role, text))

    def row(self) -> tuple:
        cost, audit, written = self.repair.result()
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, LONG)
        counts = (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)
        if not self.with_text:
            return (*counts, written[0].hexdigest())
        lines = []
        while written is not None:
            written, line = written
            lines.append(line)
        repaired = b"\n".join(reversed(lines))
        return (*counts, hashlib.sha256(repaired).hexdigest(), repaired.decode())


def repair_conversations(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None,
    with_text: bool = False,
) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and,
    with_text, the repaired conversation: one row per conversation.

    Rows are taken by turn (nulls first), equal turns by role and a hash of the text. A row is blank without any
    character but blanks, else a duplicate if its role and text came earlier, else truncated if
    its last such character is no full stop. Blank and duplicate rows must go (4 each); any row
    may go (4), stay (0, or 3 if truncated) or get another role (3 more); empty turns of user or
    assistant may come in anywhere (3). The cheapest edits that make the initials of the roles
    `(s?(ua)+)?` are taken (a row without any role must change or go); of several, that whose initials (Keep, Rerole, Delete, Insert)
    come first. `gaps` are turns missing between the first and the last one; `illegal` are
    neighbours before repair whose initials are not su, ua or au.

    Null roles and texts are one blank. A null key is a conversation like others. `times` is how
    often each row occurs, one after the other (once by default); a conversation whose rows all
    occur 0 times has zeros, an empty audit and the digest of an empty text. Repeated rows are
    duplicates. Other columns are not read; an empty table gives no rows. One repaired text, with
    its conversation's audit, must fit a cell (2 GB).
    """
    kind = rows.schema[key].dataType.simpleString()
    blank = F.lit(" ")
    taken = rows.select(
        F.col(key).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text).cast("string"), blank).alias("text"), (F.lit(1) if times is None else times).cast("long").alias("times"),
    )
    mark = F.when(F.col("times") > 0, F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    taken = taken.repartition("conv_id").withColumn("mark", mark)
    taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "mark").orderBy(F.asc_nulls_first("turn"))))
    taken = taken.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "mark", "nth")
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string" + ", repaired string" * with_text
    names = [c.strip().split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def ready(done: list[Reading], typed: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*(r.row() for r in done)))
            kinds = [typed, *[pa.int64()] * len(COUNTS), *[pa.string()] * (len(names) - 1 - len(COUNTS))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        typed = None
        for batch in batches:
            typed, done = batch.schema.field("conv_id").type, []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "times", "nth")] + [as_bytes(batch.column(c)) for c in ("role", "text")]
            for conv, at, often, nth, who, said in zip(*columns):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now)
                    now = Reading(conv, with_text)
                for copy in range(often):
                    now.add(at, who, said, nth + copy > 1)
            if done:
                yield ready(done, typed)
        if now is not None:
            yield ready([now], typed)

    return taken.select("conv_id", "turn", "role", "text", "times", "nth").mapInArrow(run, schema)

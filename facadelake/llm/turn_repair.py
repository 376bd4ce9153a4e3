"""Least-cost repair of conversations whose turns are blank, repeated, cut off or out of order.

The roles' initials of a repaired conversation are empty or an optional system turn and then pairs of user and assistant. An automaton
with four states reads them: 0 at the begin, 1 after ``s``, 2 after ``u``, 3 after ``a``; a conversation may end in 0 or 3. Edits are
letters: K keeps a turn, R gives it the one of user and assistant that the state asks for, D deletes it, I inserts that one without text.
So a string of letters has one reading only, and the ASCII-least string of least cost is found by taking at each step the least
letter that still leads to the least cost: a walk along tight edits by the costs that remain.

Costs that remain are worked out backwards, for the four states at every turn. They are kept at checkpoints only, about the square root of
a conversation's turns apart, and the turns between two checkpoints are a block:

* ``steps``: the least cost through a block from each state to each state, all blocks at once;
* ``checkpoints``: per conversation, from the last block to the first, the four costs that remain at each block's end;
* ``walks``: each block is worked out again from the costs at its end and walked forward from each state;
* ``starts``: per conversation, the state in which each block is entered, which picks its walk.

So no task holds more than the square root of a conversation's turns, and blocks of one conversation run in parallel. A turn is one letter in
a block: its role's initial and its fault.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from facadelake.llm.common import written
from facadelake.operators.hotkeys import ranked

LEAST_BLOCK = 64  # turns in a block, if the square root is smaller
PIECE = 8  # bits: turn numbers that are ranked together
SPACE = " \t\n\x0b\x0c\r"
FAR = 1 << 50
NEEDED = (2, 2, 3, 2)  # the state after the role that a state asks for: user, but assistant after a user
LEGAL = {"su", "ua", "au"}
# Letters of turns: four initials (s, u, a, others) times four faults (none, truncated, blank, repeated).
INITIALS, FAULTS = "sua?", ("", "truncated", "blank", "duplicate")


def letter(initial: Column, fault: Column) -> Column:
    """``A`` to ``P``: 4 * place of the initial + place of the fault."""
    at = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(65) + at * 4 + fault)


def damaged(conversations: DataFrame) -> DataFrame:
    """``(cid, turn, role, text)`` after a damage that depends on the checksum of ``conv_id:turn``, modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats it, 4 makes it the user's. Nulls are one space.
    ``cid`` is the id in decimal, a space without one.
    """
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    what = F.crc32(F.concat_ws(":", said["conv_id"], said["turn"]).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.translate(said["text"], ".!?", "")).otherwise(said["text"])
    role = F.when(what == 4, "user").otherwise(said["role"])
    rows = conversations.select(said["conv_id"].alias("cid"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), what.alias("what")).where("what <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("what")


def _identity() -> Column:
    return F.unhex(F.md5(F.concat(F.md5(F.col("role").cast("binary")), F.col("text")).cast("binary")))


def judged(rows: DataFrame) -> DataFrame:
    """``(cid, pos, turn, same, letter)`` of the damaged rows: place from 1, digest of role and text, initial and first fault.

    Ordered by turn, null first; rows of one turn by role and digest, so copies are neighbours.
    """
    bare = F.rtrim(F.translate("text", SPACE, " " * len(SPACE)))
    light = rows.select(
        "cid", "turn", F.md5(F.col("role").cast("binary")).alias("by_role"), _identity().alias("same"), F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), "role",
    )
    piece = F.coalesce(F.shiftright("turn", PIECE), F.lit(-(1 << 60)))
    placed = written(ranked(light, ["cid"], [F.col("turn").asc_nulls_first(), "role", "same"], piece, "pos").drop("by_role", "role"), "repair-turns")
    # First places, one for each text and role of a conversation: rows meet them by place, never by text.
    firsts = placed.groupBy("cid", "same").agg(F.min("pos").alias("pos")).select("cid", "pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 2).when(F.col("first").isNull(), 3).when(F.col("cut"), 1).otherwise(0)
    return placed.join(firsts, ["cid", "pos"], "left").select("cid", "pos", "turn", "same", letter(F.col("initial"), fault).alias("letter"))


def blocks_of(turns: DataFrame, least: int) -> DataFrame:
    """``(cid, block, letters, same)``: turns between checkpoints, in order."""
    sizes = turns.groupBy("cid").agg(F.greatest(F.lit(least), F.ceil(F.sqrt(F.max("pos")))).cast("long").alias("size"))
    dealt = turns.join(sizes, "cid").withColumn("block", F.expr("(pos - 1) div size"))
    inside = dealt.groupBy("cid", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "letter", "same"))).alias("t"))
    return inside.select("cid", "block", F.concat_ws("", F.col("t.letter")).alias("letters"), F.col("t.same").alias("same"))


# --- costs and walks of one block ---------------------------------------------------------------------------


def _choices(code: str, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a turn in a state: letter, cost, next state; ASCII order."""
    initial, fault = divmod(ord(code) - 65, 4)
    out = [("D", 3, state)]
    if fault < 2:
        if initial == 0 and state == 0:
            out.append(("K", fault, 1))
        elif initial in (1, 2) and NEEDED[state] == initial + 1:
            out.append(("K", fault, NEEDED[state]))
        out.append(("R", 2 + fault, NEEDED[state]))
    return out


_TABLE = {chr(65 + i): [_choices(chr(65 + i), q) for q in range(4)] for i in range(16)}


def _inserted(costs: list[int]) -> list[int]:
    """The costs that remain when turns may be inserted first; more than two never pay."""
    return [min(costs[q], 2 + costs[NEEDED[q]], 4 + costs[NEEDED[NEEDED[q]]]) for q in range(4)]


def remaining(letters: str, after: tuple[int, ...]) -> list[list[int]]:
    """Costs that remain before each turn of a block and at its end, by state; ``after``: at its end, insertions there included."""
    costs = [list(after)]
    for code in reversed(letters):
        then = costs[-1]
        costs.append(_inserted([min(c + then[s] for _, c, s in _TABLE[code][q]) for q in range(4)]))
    return costs[::-1]


@lru_cache(maxsize=20_000)
def step(letters: str) -> tuple[int, ...]:
    """Least cost through the block from each state to each state, 16 numbers."""
    ways = [remaining(letters, tuple(0 if q == end else FAR for q in range(4)))[0] for end in range(4)]
    return tuple(ways[end][q] for q in range(4) for end in range(4))


END = tuple(_inserted([0, FAR, FAR, 0]))


@lru_cache(maxsize=20_000)
def walk(letters: str, after: tuple[int, ...], last: bool) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """The ASCII-least tight edits through a block from each state, and the state they lead to.

    Insertions before a block's first turn belong to it, those after the conversation's last turn to the last block.
    """
    costs = remaining(letters, after)
    audits, ends = [], []
    for q in range(4):
        out = []
        for i, code in enumerate(letters):
            while True:
                left = costs[i][q]
                options = [("I", 2 + costs[i][NEEDED[q]], NEEDED[q], 0)] + [(x, c + costs[i + 1][s], s, 1) for x, c, s in _TABLE[code][q]]
                name, _, q, moved = min(o for o in options if o[1] == left)
                out.append(name)
                if moved:
                    break
        while last and q in (1, 2):
            out.append("I")
            q = NEEDED[q]
        audits.append("".join(out))
        ends.append(q)
    return tuple(audits), tuple(ends)


def edited(letters: str, audit: str, state: int) -> list[tuple[int | None, str | None]]:
    """The turns that are left: place in the block (None: inserted), and the role given (None: its own)."""
    out, i = [], 0
    for x in audit:
        if x == "D":
            i += 1
            continue
        to = 1 if x == "K" and ord(letters[i]) - 65 < 4 else NEEDED[state]
        out.append((None if x == "I" else i, None if x == "K" else ("user", "assistant")[to - 2]))
        state = to
        i += x != "I"
    return out


# --- stages over all blocks -----------------------------------------------------------------------------------


def _mapped(df: DataFrame, fn: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows ``fn(*row)`` of every row of ``df``, batch by batch."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in fn(*row)]
            for at in range(0, len(rows), 2000):
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows[at : at + 2000]), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def steps(blocks: DataFrame) -> DataFrame:
    """Per block its 16 costs, counts of faults, pairs of neighbours that may not follow each other, first and last initial."""

    def one(cid: str, block: int, letters: str) -> list[tuple]:
        codes = [ord(x) - 65 for x in letters]
        initials = "".join(INITIALS[c // 4] for c in codes)
        illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(codes) - 1))
        return [(cid, block, list(step(letters)), *(sum(c % 4 == f for c in codes) for f in (2, 3, 1)), illegal, initials[0], initials[-1])]

    return _mapped(
        blocks.select("cid", "block", "letters"), one,
        "cid string, block long, step array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string",
    )


def checkpoints(stepped: DataFrame) -> DataFrame:
    """Per conversation its figures and ``ends``: the four costs that remain at the end of every block, from the last to the first."""
    grouped = stepped.groupBy("cid").agg(
        F.sort_array(F.collect_list(F.struct("block", "step", "first", "last"))).alias("b"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    )

    def one(cid: str, b: list[dict], blank: int, duplicate: int, truncated: int, illegal: int) -> list[tuple]:
        ends, after = [], END
        for x in reversed(b):
            ends.append({"block": x["block"], "after": list(after), "is_last": x is b[-1]})
            after = tuple(min(x["step"][4 * q + e] + after[e] for e in range(4)) for q in range(4))
        illegal += sum(x["last"] + y["first"] not in LEGAL for x, y in zip(b, b[1:]))
        return [(cid, blank, duplicate, truncated, illegal, after[0], ends)]

    return _mapped(
        grouped.select("cid", "b", "blank", "duplicate", "truncated", "illegal"), one,
        "cid string, blank long, duplicate long, truncated long, illegal long, cost long, ends array<struct<block:long,after:array<long>,is_last:boolean>>",
    )


def walks(blocks: DataFrame, checked: DataFrame) -> DataFrame:
    """Per block its edits from each state, and the states they lead to."""
    ends = checked.select("cid", F.explode("ends").alias("e")).select("cid", "e.*")

    def one(cid: str, block: int, letters: str, after: list[int], is_last: bool) -> list[tuple]:
        audits, states = walk(letters, tuple(after), is_last)
        return [(cid, block, list(audits), list(states))]

    met = blocks.join(ends, ["cid", "block"]).select("cid", "block", "letters", "after", "is_last")
    return _mapped(met, one, "cid string, block long, audits array<string>, states array<long>")


def starts(walked: DataFrame) -> DataFrame:
    """Per block the state it is entered in."""
    grouped = walked.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("block", "states"))).alias("b"))

    def one(cid: str, b: list[dict]) -> list[tuple]:
        state, out = 0, []
        for x in b:
            out.append((cid, x["block"], state))
            state = x["states"][state]
        return out

    return _mapped(grouped, one, "cid string, block long, state long")


def left_turns(blocks: DataFrame, picked: DataFrame) -> DataFrame:
    """``(cid, block, at, same, role)``: the turns of the repaired conversations in order; ``same`` is null where inserted, ``role`` where kept."""

    def one(cid: str, block: int, letters: str, same: list[bytes], audit: str, state: int) -> list[tuple]:
        return [(cid, block, at, None if i is None else same[i], role) for at, (i, role) in enumerate(edited(letters, audit, state))]

    met = blocks.join(picked, ["cid", "block"]).select("cid", "block", "letters", "same", "audit", "state")
    return _mapped(met, one, "cid string, block long, at long, same binary, role string")


def repaired_rows(rows: DataFrame, left: DataFrame) -> DataFrame:
    """``(cid, block, at, role, text)`` of the repaired conversations. A text may come more than once if a turn was repeated."""
    texts = rows.where("copy = 0").select("cid", _identity().alias("same"), F.col("role").alias("own"), "text")
    kept = left.where("same IS NOT NULL").join(texts, ["cid", "same"]).select("cid", "block", "at", F.coalesce("role", "own").alias("role"), "text")
    return kept.unionByName(left.where("same IS NULL").select("cid", "block", "at", "role", F.lit("").alias("text")))


def checksums(repaired: DataFrame) -> DataFrame:
    """``(cid, repaired_sha256)`` of ``role:text``, joined by newlines.

    A checksum takes one turn after the other; a conversation is a stream in one task with the checksum as its only state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, last, state, out = None, None, None, []
        for batch in batches:
            for cid, block, at, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if cid != who:
                    if who is not None:
                        out.append((who, state.hexdigest()))
                    who, last, state = cid, (block, at), hashlib.sha256(f"{role}:{text}".encode())
                elif (block, at) != last:
                    last = (block, at)
                    state.update(f"\n{role}:{text}".encode())
            if out:
                yield pa.record_batch([pa.array(x) for x in zip(*out)], ["cid", "repaired_sha256"])
                out = []
        if who is not None:
            yield pa.record_batch([pa.array([who]), pa.array([state.hexdigest()])], ["cid", "repaired_sha256"])

    dealt = repaired.repartition("cid").sortWithinPartitions("cid", "block", "at")
    return dealt.select("cid", "block", "at", "role", "text").mapInArrow(run, "cid string, repaired_sha256 string")


def repair(conversations: DataFrame, damage: Callable[[DataFrame], DataFrame] = damaged, least_block: int = LEAST_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Audits of all conversations of ``(conv_id, turn, role, text)``, and the turns ``(cid, block, at, role, text)`` of the repaired ones.

    ``damage`` makes the rows ``(cid, turn, role, text, copy)`` that are repaired. An audit has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``
    and ``repaired_sha256``. Null roles, texts, turns and ids are one space; rows without id are one conversation, its ``conv_id`` is null.
    Null turns come first; rows of one turn are ordered by role and a digest, so repeated rows are neighbours and all but the first are
    duplicates. A turn with an empty role has no initial and is never kept as it is. A conversation without rows has zeros, an empty audit and the empty string's checksum. An empty table gives an
    empty result. Other columns are not read.
    """
    rows = damage(conversations)
    turns = written(judged(rows), "repair-judged")
    blocks = written(blocks_of(turns, least_block), "repair-blocks")
    checked = written(checkpoints(steps(blocks)), "repair-checkpoints")
    walked = written(walks(blocks, checked), "repair-walks")
    picked = walked.join(starts(walked), ["cid", "block"]).select("cid", "block", F.element_at("audits", (F.col("state") + 1).cast("int")).alias("audit"), "state")
    picked = written(picked, "repair-audits")
    out = written(repaired_rows(rows, left_turns(blocks, picked)), "repair-out")
    audits = picked.groupBy("cid").agg(F.concat_ws("", F.sort_array(F.collect_list(F.struct("block", "audit")))["audit"]).alias("audit"))
    spans = turns.groupBy("cid").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("cid")).distinct()
    facts = ids.join(spans, "cid", "left").join(checked.drop("ends"), "cid", "left").join(audits, "cid", "left").join(checksums(out), "cid", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return facts.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")), out

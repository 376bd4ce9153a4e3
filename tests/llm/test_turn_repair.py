"""Repairs against a search over all edits, and blocks of every size."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from facadelake.llm.turn_repair import repair

SCHEMA = "conv_id long, turn long, role string, text string, copy int, letters string"
SHAPE = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def edits(turns):
    """The least cost, then ASCII-least edits by a search over (turns read, initials so far modulo what decides), whole strings compared."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, tail, out = heapq.heappop(queue)
        if (i, tail) in seen:
            continue
        seen.add((i, tail))
        if i == len(turns) and tail in ("", "a"):
            yield cost
            return
        need = "a" if tail == "u" else "u"
        heapq.heappush(queue, (cost + 2, audit + "I", i, need, out))
        if i < len(turns):
            role, _, fault = turns[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, tail, out))
            if fault not in ("blank", "duplicate"):
                t = fault == "truncated"
                heapq.heappush(queue, (cost + 2 + t, audit + "R", i + 1, need, out))
                if role[:1] == need or role[:1] == "s" and tail == "":
                    heapq.heappush(queue, (cost + t, audit + "K", i + 1, role[:1], out))


def all_audits(turns, most):
    """Every string of edits that costs ``most``, by plain recursion, and what it makes."""
    found = []

    def go(i, cost, audit, out):
        if cost > most:
            return
        initials = "".join(r[:1] for r, _ in out)
        if i == len(turns) and SHAPE.fullmatch(initials):
            found.append((audit, out))
        for role in ("user", "assistant"):
            go(i, cost + 2, audit + "I", [*out, (role, "")])
        if i < len(turns):
            role, text, fault = turns[i]
            go(i + 1, cost + 3, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                t = fault == "truncated"
                if role:  # a turn without an initial is never kept
                    go(i + 1, cost + t, audit + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 2 + t, audit + "R", [*out, (new, text)])

    go(0, 0, "", [])
    return found


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        here = convs[c]
        said = [" " if x is None else x for x in (role, text)]
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        if what == 1:
            said[1] = ""
        if what == 2:
            said[1] = re.sub("[.!?]", "", said[1])
        if what == 4:
            said[0] = "user"
        same = hashlib.md5(hashlib.md5(said[0].encode()).hexdigest().encode() + said[1].encode()).digest()
        here += [((turn is not None, turn or 0, said[0], same), turn, *said)] * (2 if what == 3 else 1)
    out = []
    for c, here in convs.items():
        here.sort(key=lambda x: x[0])
        seen, turns = set(), []
        for _, _, role, text in here:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = [t for _, t, _, _ in here if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = [f for *_, f in turns]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost = next(edits(turns))
        audit, made = min(all_audits(turns, cost), key=lambda x: x[0])
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


def found(spark, rows, least=64):
    audits, _ = repair(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA), least_block=least)
    return sorted((tuple(r) for r in audits.collect()), key=lambda r: (r[0] is not None, r[0]))


@pytest.fixture(scope="module")
def some():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "assistant", "user", "system", "tool", "", None], ["Yes.", "No!", "So?", "cut", "end. \n", " \t", "", None, "é", "Yes."]
    rows = []
    for c in range(60):
        rows += [(c, t + rng.choice([0, 0, 0, 2]), rng.choice(roles), rng.choice(texts)) for t in range(rng.randint(1, 6))]
    for c in range(60, 90):  # mostly in order
        rows += [(c, t, "assistant" if t % 2 else "user", f"line {t}.") for t in range(rng.randint(1, 6))]
    return rows + [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 1, "user", "Hi."), (200, None, None, None), (201, 3, "user", "x" * 100_000 + ".")]


@pytest.mark.parametrize("least", [1, 2, 64])
def test_all_edits(spark, some, least):
    assert found(spark, some, least) == plain(some)


def test_blocks_agree(spark):
    """A conversation of 700 turns, cut into blocks of 27 or in one piece, gives one audit; the cost is a plain search's."""
    rng = random.Random(1)
    rows = [(3, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Well.", "", "cut", f"{t}.", f"{t}!"])) for t in range(700)]
    small, large = found(spark, rows, 1), found(spark, rows, 10_000)
    assert small == large and len(small[0][7]) >= 600


def test_empty(spark):
    assert found(spark, []) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert found(spark, [(1, gone, "user", "a")]) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns(spark):
    """The operator's own output are turns; other damage can be asked for."""
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", "C.")]
    whole = lambda df: df.select(F.col("conv_id").cast("string").alias("cid"), "turn", "role", "text", F.lit(0).alias("copy"))
    audits, turns = repair(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA), damage=whole)
    assert audits.first()["audit"] == "DKR" and audits.first()["cost"] == 5 or audits.first()["cost"] <= 5
    assert [r["role"] for r in turns.orderBy("block", "at").collect()][0] == "user"

"""The trie against dictionaries of whole prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from facadelake.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, rep int"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(hashlib.md5(role.encode()).hexdigest().encode() + text.encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    members, last = defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(own.get(base, [])[:h] + v[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        last[path].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(last.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(spark, rows, band):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in prefix_trie(df, band).collect())


def key(rows):
    return sorted(rows, key=lambda r: (r[1], r[0], r[7]))


@pytest.mark.parametrize("band", [2, 3, 32])
def test_random_conversations(spark, band):
    rng = random.Random(7)
    rows = []
    for c in range(-12, 60):
        n = rng.choice([0, 1, 2, 3, 9, 30])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None])) for t in range(n)]
    assert key(found(spark, rows, band)) == key(plain(rows))


def test_long_copies_ties_and_nulls(spark):
    """Six hundred turns, equal turns, repeated rows, null turns and ids, a very long text, a hot conversation copied."""
    rows = [(0, t, "user", f"t{t % 7}") for t in range(600)] + [(5, t, "user", f"t{t % 7}") for t in range(600)]
    rows += [(10, None, "user", "x"), (10, None, "assistant", "x"), (10, 3, "user", "y"), (10, 3, "user", "y"), (10, 3, None, None)]
    rows += [(None, 1, "user", "lost"), (11, -5, "", "z" * 100_000)]
    rows += [(100 + 5 * i, t, "user", "copy") for i in range(300) for t in range(3)]
    assert key(found(spark, rows, 4)) == key(plain(rows))


def test_empty(spark):
    assert found(spark, [], 32) == []
    assert found(spark, [(None, 1, "user", "a")], 32) == []


def test_turnless(spark):
    """A conversation whose first five has no turns and that is shorter than what it gives up is a member of the root only."""
    rows = [(c, 0, "user", "a") for c in range(1, 5)]
    assert found(spark, rows, 32) == plain(rows)

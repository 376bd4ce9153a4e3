"""A trie over the turns of conversations, with totals of every subtree by depth bands.

A conversation's turns are its path from the textless root. A node is known by the sum of its path's turn hashes, each salted with its
depth, so paths get their nodes from running sums: the depth axis is cut into pieces, and only piece totals are combined per conversation.

Totals of subtrees, without walking parent by parent and without giving every node all its ancestors:

* Depths are cut into bands of ``BAND`` levels. A node adds its values to its ancestors within its band only, ``BAND`` rows at most. A
  band's root then has the total of its part of the band.
* The roots of bands are a trie of their own, ``BAND`` times as flat, and are rolled up the same way, until one band holds all depths.
* From the top down, the completed total of every band root is added to its ancestors in the band above, ``BAND`` rows at most again.

With D levels that is 2 * log(D) / log(BAND) rounds. A node's ancestors are read off the path of its smallest member, so bands need
no parent links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facadelake.llm.common import written
from facadelake.operators.hotkeys import ranked

BAND = 32  # levels of a band
PIECE = 8  # bits: turns of a piece of the running sums
SHARED = 8  # turns at most that a conversation takes from the first one of its five
KEY = ["depth", "k1", "k2"]
_LOW = (1 << 32) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.md5(role.cast("binary")), text).cast("binary")))


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(c, r, digest, bytes)`` of all rows with a ``conv_id``: place in the conversation from 1, digest of role and text, bytes of the text.

    Ordered by turn, null first; rows of one turn by their digest.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    piece = F.coalesce(F.shiftright("turn", PIECE), F.lit(-(1 << 60)))
    return ranked(rows, ["c"], [F.col("turn").asc_nulls_first(), "digest"], piece, "r").select("c", "r", "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations ``(c, m)`` with their rebuilt number of turns, and their rebuilt turns ``(c, m, depth, digest, bytes)``.

    The first h turns are those of conversation c - c % 5, as many as it has; the others are c's own after its first h; h is the
    unsigned crc32 of c in decimal, modulo 9.
    """
    sizes = turns.groupBy("c").agg(F.max("r").alias("n"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % (SHARED + 1)
    own = sizes.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % 5).alias("base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = own.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("n_base")), "base", "left").select(
        "c", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("m")
    )
    first = turns.where(F.col("r") <= SHARED).withColumnRenamed("c", "base").join(convs, "base").where("r <= taken").select("c", "m", F.col("r").alias("depth"), "digest", "bytes")
    rest = turns.join(convs, "c").where("r > h").select("c", "m", (F.col("r") - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes")
    return convs.select("c", "m"), first.unionByName(rest)


def paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``(c, m, depth, k1, k2, p1, p2, bytes)``: the node of every turn, the one above it, and the root for every conversation."""
    words = {}
    for i in (1, 2):
        w = F.xxhash64(F.lit(i), F.col("depth"), F.col("digest"))
        words |= {f"h{i}": F.shiftrightunsigned(w, 32), f"l{i}": w.bitwiseAND(F.lit(_LOW))}
    rows = turns.withColumns(words).withColumn("piece", F.shiftright("depth", PIECE)).drop("digest")
    totals = rows.groupBy("c", "piece").agg(*[F.sum(w).alias(w) for w in words])
    before = Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("c", "piece", *[F.sum(F.col(w).bitwiseAND(F.lit(_LOW))).over(before).alias(f"{w}_start") for w in words]).where("piece > 0")
    upto = Window.partitionBy("c", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumns({f"{w}_upto": F.sum(w).over(upto) for w in words}).join(starts, ["c", "piece"], "left")

    def key(i: int, above: bool) -> Column:
        high, low = (
            (F.col(f"{w}_upto") - (F.col(w) if above else F.lit(0)) + F.coalesce(f"{w}_start", F.lit(0))).bitwiseAND(F.lit(_LOW)) for w in (f"h{i}", f"l{i}")
        )
        return F.shiftleft(high, 32).bitwiseOR(low)

    out = sums.select("c", "m", "depth", key(1, False).alias("k1"), key(2, False).alias("k2"), key(1, True).alias("p1"), key(2, True).alias("p2"), "bytes")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    return out.unionByName(convs.select("c", "m", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("bytes")))


def _bands(path: DataFrame, unit: int, band: int) -> DataFrame:
    """``(c, b, above)``: the nodes at depths divisible by ``unit`` on each path, ``band`` of them at most together."""
    at = F.col("depth")
    return path.where(at % unit == 0).groupBy("c", F.floor(at / (unit * band)).cast("long").alias("b")).agg(F.collect_list(F.struct(*KEY)).alias("above"))


def _added(rows: DataFrame, above: DataFrame, band: Column) -> DataFrame:
    """The values of ``rows (rep, depth, leaves, saved)`` once for each of their ancestors, themselves included, in the band named."""
    met = rows.withColumn("b", band).join(above.withColumnRenamed("c", "rep"), ["rep", "b"])
    mine = met.select("leaves", "saved", F.explode(F.filter("above", lambda a: a["depth"] <= F.col("depth"))).alias("a"))
    return mine.select("a.*", "leaves", "saved")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def rolled_up(nodes: DataFrame, path: DataFrame, band: int) -> DataFrame:
    """Rows ``(depth, k1, k2, leaves, saved)`` whose sums per node are the totals of its subtree.

    ``nodes`` ``(depth, k1, k2, rep, leaves, saved)`` have a value of their own each; ``path (c, depth, k1, k2)`` has all conversations' nodes.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    levels, unit, values = [], 1, nodes
    while True:
        above = _bands(path, unit, band)
        part = _added(values, above, F.floor(F.col("depth") / (unit * band)).cast("long"))
        levels.append((unit, above, part))
        unit *= band
        if deepest < unit:
            break
        roots = _summed(part.where(F.col("depth") % unit == 0))
        values = written(roots.join(nodes.select(*KEY, "rep"), KEY), "trie-roots")
    done = levels[-1][2]
    for unit, above, part in reversed(levels[:-1]):
        roots = _summed(done.where("depth > 0")).join(nodes.select(*KEY, "rep"), KEY)
        done = part.unionByName(_added(roots, above, F.floor(F.col("depth") / (unit * band)).cast("long") - 1))
    return done


def ends(path: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)`` of the nodes at which conversations end.

    Ids are joined in runs of 1,024 numbers first. A checksum takes one run after the other, so a node's runs meet in one task, as a
    stream with the checksum as its only state.
    """
    run = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")))
    runs = path.where("depth = m").groupBy(*KEY, F.shiftright("c", 10).alias("run")).agg(run.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if key == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            if out:
                yield pa.record_batch([pa.array(x) for x in zip(*out)], [*KEY, "ends_sha256"])
                out = []
        if node is not None:
            yield pa.record_batch([pa.array([x]) for x in (*node, state.hexdigest())], [*KEY, "ends_sha256"])

    dealt = runs.repartition(*KEY).sortWithinPartitions(*KEY, "run").select(*KEY, "ids")
    return dealt.mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node of the trie over the rebuilt ``conversations (conv_id, turn, role, text)``, see ``rebuilt``.

    ``conv_id`` is the smallest member, the conversations that begin with the node's turns; ``n_convs`` counts them. ``n_leaves`` and ``saved_tokens`` are over
    the node's subtree, itself included: nodes without children, and (members - 1) * bytes of the last text. ``ends_sha256`` is of the
    members that end at the node, in decimal, ascending, joined by commas.

    Null roles and texts are empty; null turns come first; rows of one turn are ordered by a digest of role and text, and repeated rows
    are turns of their own. Rows without ``conv_id`` belong to no conversation. An empty table has no node, not even
    the root. Other columns are not read. Very long texts are only hashed.
    """
    turns = written(turns_of(conversations), "trie-turns")
    path = written(paths(*rebuilt(turns)), "trie-paths")
    nodes = written(
        path.groupBy(*KEY)
        .agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("m").alias("deepest"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
        .select(*KEY, "rep", "n_convs", "p1", "p2", (F.col("deepest") == F.col("depth")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")),
        "trie-nodes",
    )
    # All that is known of a node meets in one aggregate: its totals, its children, its ends, itself.
    totals = rolled_up(nodes.select(*KEY, "rep", "leaves", "saved"), path.select("c", *KEY), band)
    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).cast("long").alias("children"))
    facts = totals.unionByName(children, True).unionByName(ends(path), True).unionByName(nodes.select(*KEY, "rep", "n_convs", "p1", "p2"), True)
    whole = facts.groupBy(*KEY).agg(
        *[F.max(x).alias(x) for x in ("rep", "n_convs", "p1", "p2")], F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        F.coalesce(F.sum("children"), F.lit(0)).alias("n_children"), F.coalesce(F.max("ends_sha256"), F.lit(_EMPTY)).alias("ends_sha256"),
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent_conv_id"))
    return whole.join(parents, ["depth", "p1", "p2"], "left").select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )

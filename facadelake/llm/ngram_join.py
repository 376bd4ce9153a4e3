"""N-gram Jaccard join over count vectors.

Shingle hashes are dealt into groups; a text becomes the point of its group counts. The overlap of two
shingle sets is at most the sum over all groups of the smaller count, so a pair whose sum stays below the
overlap that its sizes demand cannot link. Points lie in R-tree nodes that bound the same way. Pairs that
survive are compared by their whole shingle sets.

How pairs meet without comparing all with all, and without losing one:

* Texts with equal shingle sets are one class; one document stands for it.
* A pair that links differs in at most D shingles, D following from the sizes. The hash range is cut into
  more than D groups, so some groups of the pair are equal as sets, and of those at least one is not
  empty (see ``n_groups``). The hash of a group's content is a cell; pairs meet in cells.
* In every cell each member is compared with one pivot: linear, whatever the cell's size.
  What links is labelled by connected component. Cells whose members still have different labels are
  searched as R-trees of several levels; pairs with equal labels need no search, as their component is
  known. A large cell is cut into leaves, and pairs of leaves are spread over tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facadelake.llm.common import flat, pieces, written
from facadelake.llm.shingles import mix, shingle_sets
from facadelake.operators.components import connected_components

# Groups of the count vectors that cells are searched with; small and large sets get fewer and more.
LEAST_DIMS, MOST_DIMS = 64, 512
BAND = 1.25  # ratio of the largest to the smallest set size that share a cutting into groups
LEAF = 2048  # points in a leaf of a large cell
ROUNDS = 4  # cells are met in so many rounds, each with a part of all cells: the disk holds the shuffle files of one round
NODE = 32  # points in a lowest node of the tree inside a task
FAN = 8  # nodes in a node above those
OPEN = 64  # pairs of nodes opened at a time
TRIED = 4096  # pairs of nodes or points whose bounds are worked out at a time


def links(shared, size_a, size_b, percent: int):
    """Whether sets link: 100 * shared >= percent * (size of the union)."""
    return (100 + percent) * shared >= percent * (size_a + size_b)


def least_shared(total, percent: int):
    """Smallest overlap of two sets of ``total`` elements together that link."""
    return -(-percent * total // (100 + percent))


def band_of(n: int) -> int:
    return int(math.log(n) / math.log(BAND) + 1e-9)


def bands(n: int, percent: int) -> list[int]:
    """Bands a set of ``n`` is put in: its own, and the lower ones that its smallest partner is in."""
    if n == 0:
        return []
    smallest = -(-percent * n // 100)
    return list(range(band_of(max(1, smallest)), band_of(n) + 1))


@lru_cache(maxsize=4096)
def n_groups(band: int, percent: int) -> tuple[int, int]:
    """Groups for a band, and how many of them may be empty before empty ones become cells, too.

    A pair whose smaller set is in the band differs in at most D shingles, so of D + 1 + spare groups
    spare + 1 are equal. If one of the two has at most ``spare`` empty groups, one of the equal groups is
    not empty. Otherwise both have more empty groups than that and put those into cells as well.
    """
    large = int(BAND ** (band + 1)) + 2
    while large > 1 and band_of(large) > band:
        large -= 1
    small = BAND**band
    differ = (large + 100 * large // percent) * (100 - percent) // (100 + percent)
    spare = 0
    while True:
        groups = differ + 1 + spare
        empty = groups * math.exp(-small / groups)
        want = math.ceil(empty + 4 * math.sqrt(empty)) if empty > 0.01 else 0
        if want <= spare or spare >= differ:
            return groups, spare
        spare = min(want, differ)


def cells_of(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Cell ids of a sorted shingle set."""
    out = []
    mixed = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    top = (shingles >> np.uint64(32)).astype(np.uint64)
    for band in bands(len(shingles), percent):
        groups, spare = n_groups(band, percent)
        group = (top * np.uint64(groups)) >> np.uint64(32)  # sorted, as the hashes are
        at = np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))
        size = np.diff(at).astype(np.uint64)
        content = mixed[at[1:]] - mixed[at[:-1]]
        keys = mix(content + mix(np.arange(groups, dtype=np.uint64) + np.uint64(band << 32)) + size)
        out.append(keys if (size == 0).sum() > spare else keys[size > 0])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``(doc_id, n, sig, v, cells)`` of all rows: set size, digest of the set, group counts, cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = shingle_sets(*flat(batch.column("text")), k)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()),
                    pa.array([packed(count_vector(s, dims(len(s)))) for s in found], pa.binary()),
                    pa.array([cells_of(s, percent).view(np.int64) for s in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "sig", "v", "cells"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, sig binary, v binary, cells array<long>")


def shingle_table(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, s)``: the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = shingle_sets(*flat(batch.column("text")), k)
            yield pa.record_batch([batch.column("doc_id"), pa.array([s.tobytes() for s in found], pa.binary())], ["doc_id", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, s binary")


def dims(n: int) -> int:
    """Coordinates of the points of sets that may link with one of ``n``: by its octave."""
    return min(MOST_DIMS, max(LEAST_DIMS, 1 << int(n // 2).bit_length()))


def count_vector(shingles: np.ndarray, size: int) -> np.ndarray:
    return np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)


def packed(vector: np.ndarray) -> bytes:
    """The counts in as many bytes each as the largest needs, that number first."""
    width = 1 if vector.max(initial=0) < 1 << 8 else 2 if vector.max() < 1 << 16 else 4
    return bytes([width]) + vector.astype(f"<u{width}").tobytes()


def unpacked(v: bytes) -> np.ndarray:
    return np.frombuffer(v, f"<u{v[0]}", offset=1).astype(np.int64)


def fold(vector: np.ndarray, size: int) -> np.ndarray:
    """The vector with fewer groups: groups that fall together are added."""
    return vector.reshape(-1, size).sum(0) if len(vector) > size else vector


def grown(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, side: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of a tree over points in the order it is loaded with, the root's last; level 0 are the points.

    A node of level 1 holds ``NODE`` points that follow each other, one of a higher level ``FAN`` nodes of the level below. Each node
    has the greatest count per coordinate and the range of sizes, labels and sides.
    """
    levels = [{"most": points, "low": sizes, "high": sizes, "first": labels, "last": labels, "near": side, "far": side}]
    while len(levels[-1]["low"]) > 1:
        below, width = levels[-1], NODE if len(levels) == 1 else FAN
        cuts = np.arange(0, len(below["low"]), width)
        least = {k: np.minimum.reduceat(below[k], cuts) for k in ("low", "first", "near")}
        levels.append(least | {k: np.maximum.reduceat(below[k], cuts, axis=0) for k in ("most", "high", "last", "far")})
    return levels


def may_link(level: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, percent: int, across: bool) -> np.ndarray:
    """Whether the nodes ``a`` and ``b`` of a level can hold a pair with different labels, and of both sides if ``across``, that links."""
    low, high = level["low"], level["high"]
    ok = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
    ok &= (level["first"][a] != level["last"][b]) | (level["last"][a] != level["first"][b])
    if across:
        ok &= (level["near"][a] != level["far"][b]) | (level["far"][a] != level["near"][b])
    at = np.nonzero(ok)[0]
    bound = np.minimum(level["most"][a[at]], level["most"][b[at]]).sum(1, dtype=np.int64)
    ok[at] = bound >= least_shared(low[a[at]] + low[b[at]], percent)
    return ok


def tree_pairs(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points with different labels whose bounds allow a link.

    Points are packed by side, label, size and their widest coordinates into the nodes of a tree of several levels, which is searched
    against itself from the root: a pair of nodes is opened only if the sum of the smaller of their most counts reaches what their
    least sizes demand. Pairs of nodes wait on a stack and are opened ``OPEN`` at a time, so memory is bounded by the depth. ``side``:
    0 and 1 are the leaves of a pair of leaves and only pairs across count; if all are 0, all pairs do.
    """
    if len(points) < 2:
        return
    spread = points.var(0).argsort()[::-1][:2]
    order = np.lexsort([*(points[:, c] for c in spread), (np.log(np.maximum(sizes, 1)) * 20).astype(int), labels, side])
    across = bool(side.any())
    levels = grown(points[order], sizes[order], labels[order], side[order])
    root = np.zeros(1, np.int64)
    waiting = [(len(levels) - 1, root, root)]
    while waiting:
        depth, a, b = waiting.pop()
        if len(a) > OPEN:
            waiting.append((depth, a[OPEN:], b[OPEN:]))
            a, b = a[:OPEN], b[:OPEN]
        width, below = NODE if depth == 1 else FAN, levels[depth - 1]
        step = np.arange(width)
        x = (a[:, None, None] * width + step[None, :, None] + np.zeros((1, 1, width), np.int64)).ravel()
        y = (b[:, None, None] * width + step[None, None, :] + np.zeros((1, width, 1), np.int64)).ravel()
        # Nodes meet themselves, points do not.
        kept = (y < len(below["low"])) & (x < len(below["low"])) & ((x < y) if depth == 1 else (x <= y))
        x, y = x[kept], y[kept]
        found = np.concatenate([may_link(below, x[c : c + TRIED], y[c : c + TRIED], percent, across) for c in range(0, len(x), TRIED)] or [np.zeros(0, bool)])
        x, y = x[found], y[found]
        if len(x) and depth == 1:
            yield order[x], order[y]
        elif len(x):
            waiting.append((depth - 1, x, y))


def verified(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that link by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist()):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                small, large = (s, t) if len(s) < len(t) else (t, s)
                at = np.searchsorted(large, small)
                shared = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                keep.append(bool(links(shared, len(s), len(t), percent)))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = pairs.join(shingles.select(F.col("doc_id").alias("a"), "s"), "a").join(shingles.select(F.col("doc_id").alias("b"), F.col("s").alias("t")), "b")
    return sides.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def not_shared(cells: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sorted lists ``i`` and ``j`` of ``cells``, which ``at`` cuts into lists, have no value in common, pair by pair."""
    out = np.ones(len(i), bool)
    order = np.argsort(i, kind="stable")
    bounds = np.nonzero(np.diff(i[order], prepend=-1, append=-1))[0]
    for low, high in zip(bounds, bounds[1:]):
        mine = cells[at[i[order[low]]] : at[i[order[low]] + 1]]
        for one in order[low:high] if len(mine) else ():
            other = cells[at[j[one]] : at[j[one] + 1]]
            place = np.searchsorted(mine, other)
            out[one] = not (mine[np.minimum(place, len(mine) - 1)] == other).any()
    return out


def searched(members: DataFrame, points: DataFrame, percent: int, leaf: int) -> DataFrame:
    """Pairs ``(a, b)`` that R-trees over the cells let through; members ``(cell, rep, label)``, points ``(rep, n, v)``.

    A pair is let through in the first of the cells that it shares. A cell above ``leaf`` members is cut into leaves by hash; a
    member goes to every pair of leaves that its leaf is in. Cells are searched in ``ROUNDS`` rounds, as a member's point goes along
    into each of its cells.
    """
    members = written(members, "ngram-open")
    own_cells = members.groupBy("rep").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    sizes = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("leaves"))
    placed = members.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("leaves")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("leaves") - 1))).select(
        "cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "rep", "label"
    )

    def pairs_of(group: pa.Table) -> np.ndarray:
        """The pairs of a cell or of two of its leaves, one a row."""
        cell, p, q = (group[c][0].as_py() for c in ("cell", "p", "q"))
        ids, sizes_, labels = (group[c].to_numpy() for c in ("rep", "n", "label"))
        counts = group["v"].to_pylist()
        size = min((len(v) - 1) // v[0] for v in counts)
        points = np.array([fold(unpacked(v), size).astype(np.uint32) for v in counts])
        side = (group["own"].to_numpy() != p).astype(int) if p != q else np.zeros(len(ids), int)
        earlier = group["earlier"].combine_chunks()
        at, cells = earlier.offsets.to_numpy(), earlier.values.to_numpy()
        found = [np.zeros((0, 2), np.int64)]
        for i, j in tree_pairs(points, sizes_, labels, side, percent):
            fresh = not_shared(cells, at, i, j)
            found.append(np.sort(np.column_stack([ids[i[fresh]], ids[j[fresh]]]), axis=1))
        return np.concatenate(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[pa.Table]:
            parts: list[pa.RecordBatch] = []
            last = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "p", "q")])
                cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), len(keys)]
                for low, high in zip(cuts, cuts[1:]):
                    key = keys[low].tolist()
                    if parts and key != last:
                        yield pa.Table.from_batches(parts)
                        parts = []
                    last = key
                    parts.append(batch.slice(low, high - low))
            if parts:
                yield pa.Table.from_batches(parts)

        for group in groups():
            if group.num_rows > 1:
                found = np.unique(pairs_of(group), axis=0)
                if len(found):
                    yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    found = []
    for i in range(ROUNDS):
        some = placed.where(F.pmod("cell", F.lit(ROUNDS)) == i).join(points, "rep").join(own_cells, "rep")
        earlier = F.slice("cells", F.lit(1), (F.array_position("cells", F.col("cell")) - 1).cast("int")).alias("earlier")
        some = some.select("cell", "p", "q", "own", "rep", "n", "label", "v", earlier).repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q")
        found.append(written(some.mapInArrow(run, "a long, b long"), "ngram-found"))
    return reduce(DataFrame.unionByName, found).distinct()


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose summed smaller counts allow a link; points ``(rep, n, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, v, w in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "v", "w"))):
                v, w = unpacked(v), unpacked(w)
                size = min(len(v), len(w))
                keep.append(bool(np.minimum(fold(v, size), fold(w, size)).sum() >= least_shared(n + m, percent)))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = f"100 * n >= {percent} * m AND 100 * m >= {percent} * n"
    left = points.select(F.col("rep").alias("a"), "n", "v")
    right = points.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("v").alias("w"))
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "n", "m", "v", "w").mapInArrow(run, "a long, b long").distinct()


def ngram_components(docs: DataFrame, k: int = 3, percent: int = 90, leaf: int = LEAF) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs (doc_id, text)``.

    Texts link when their Jaccard similarity on distinct k-word shingles is ``percent`` hundredths or more;
    ``component_id`` is the smallest ``doc_id`` that links reach. Null and word-less texts have no
    shingles and link with nothing. Repeated rows each give a row; rows of one ``doc_id`` are one node
    with several sets. A row without ``doc_id`` gets the component of its equals, else null. An empty table
    gives an empty result. Other columns are not read.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = written(sets(ids, k, percent), "ngram-sets")
    filled = base.where("n > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("n", "sig").agg(F.min("doc_id").alias("rep"))
    chosen = filled.join(classes.select(F.col("rep").alias("doc_id"), "n", "sig"), ["doc_id", "n", "sig"], "left_semi")
    members = chosen.select(F.col("doc_id").alias("rep"), F.explode("cells").alias("cell"))
    found = []
    for i in range(ROUNDS):
        some = members.where(F.pmod("cell", F.lit(ROUNDS)) == i)
        shared = some.groupBy("cell").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), F.count(F.lit(1)).alias("size")).where("x < y").select("cell", "size")
        found.append(written(some.join(shared, "cell"), "ngram-cells"))
    met = reduce(DataFrame.unionByName, found)
    # A cell's pivot is its member with the most company in all its cells: what the others are copies of.
    rank = met.groupBy("rep").agg(F.sum("size").alias("company"))
    pivots = met.join(rank, "rep").groupBy("cell").agg(F.max(F.struct("company", -F.col("rep"), "rep"))["rep"].alias("pivot"))
    placed = written(met.join(pivots, "cell"), "ngram-pivots")
    stars = placed.where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    points = filled.select(F.col("doc_id").alias("rep"), "n", "v")
    pairs = written(bounded(stars, points, percent), "ngram-pairs")
    # Ids of texts to compare: they grow with the corpus, so they are never broadcast.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(placed.where("size > 2").select(F.col("rep").alias("doc_id"))).distinct()
    shingles = written(shingle_table(ids.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), k), "ngram-shingles")
    first = written(verified(pairs, shingles, percent).distinct(), "ngram-links")
    labels = connected_components(first.select(F.lit(0).alias("all"), "a", "b"), "all").select(F.col("node").alias("rep"), "root")
    # Cells whose members, besides the pivot that all were compared with, have several labels.
    others = placed.where("size > 2 AND rep <> pivot").select("cell", "rep").join(labels, "rep", "left").select("cell", "rep", F.coalesce("root", "rep").alias("label"))
    several = others.groupBy("cell").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("cell")
    candidates = searched(others.join(several, "cell", "left_semi").distinct(), points, percent, leaf)
    second = written(verified(candidates.join(pairs, ["a", "b"], "left_anti"), shingles, percent).distinct(), "ngram-links")
    every = first.unionByName(second).select(F.lit(0).alias("all"), "a", "b")
    roots = connected_components(every, "all").select(F.col("node").alias("rep"), "root")
    out = base.select("doc_id", "n", "sig").join(classes.join(roots, "rep", "left"), ["n", "sig"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def class_links(docs: DataFrame, k: int = 3, percent: int = 90, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every link between different shingle sets, not only what joins components: ``(doc_id, n, sig)`` of the rows of ``docs (doc_id, text)``,
    the classes of equal sets ``(n, sig, rep, members)``, and the pairs ``(a, b)`` of representatives that link.

    ``doc_id`` is taken to be unique. All cells are searched, each member under a label of its own; so the work grows with the
    number of links.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = written(sets(ids, k, percent), "ngram-sets")
    filled = base.where("n > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("n", "sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    chosen = filled.join(classes.select(F.col("rep").alias("doc_id"), "n", "sig"), ["doc_id", "n", "sig"], "left_semi")
    members = chosen.select(F.col("doc_id").alias("rep"), F.explode("cells").alias("cell"))
    shared = members.groupBy("cell").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("cell")
    met = members.join(shared, "cell", "left_semi").select("cell", "rep", F.col("rep").alias("label"))
    candidates = written(searched(met, chosen.select(F.col("doc_id").alias("rep"), "n", "v"), percent, leaf), "ngram-pairs")
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    shingles = written(shingle_table(ids.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), k), "ngram-shingles")
    return base.select("doc_id", "n", "sig"), classes, written(verified(candidates, shingles, percent), "ngram-links")


def ngram_links(docs: DataFrame, k: int = 3, percent: int = 90, leaf: int = LEAF) -> DataFrame:
    """``(doc_id, n_shingles, n_links)`` of every row of ``docs (doc_id, text)``: how many other documents each links with.

    Links are counted per class and weighted by members, so copies are never paired. Texts without shingles have none;
    rows without ``doc_id`` are not counted, and have null.
    """
    base, classes, pairs = class_links(docs, k, percent, leaf)
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ways.join(classes.select(F.col("rep").alias("b"), "members"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("members").alias("others"))
    counted = classes.join(others, "rep", "left").select("n", "sig", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    n_links = F.when(F.col("n") == 0, F.lit(0)).when(F.col("doc_id").isNotNull(), F.col("links")).cast("long")
    return base.join(counted, ["n", "sig"], "left").select("doc_id", F.col("n").alias("n_shingles"), n_links.alias("n_links"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that stay when one document of each component does, the one with the smallest ``doc_id``.

    Rows without words stay, as do rows without ``doc_id``; repeated rows of one document stay or go together. All columns are kept.
    """
    found = ngram_components(docs, k, percent)
    gone = found.where("n_shingles > 0 AND component_id < doc_id").select(F.col("doc_id").alias("_llm_gone")).distinct()
    # The ids grow with the corpus, so they are never broadcast.
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col("_llm_gone"), "left_anti")

"""Exact Jaccard self-join of shingle sets in the metric space of their distance, 1 - J.

Equal sets are one node. Two sets that share nothing are at distance 1 from each other and
from every pivot, so no pivot can part them; regions therefore begin as cells of blocks:
hashes of shingles are cut into one block more than near sets of that size can differ in,
so near sets agree in a whole block. Inside, the metric works:

* Each cell has a pivot from its midst, and what shares cells with the same pivot makes a region; a further
  pivot splits it into two Voronoi regions. Every member's distance to both is counted exactly, and what is near a
  pivot is linked to it.
* A member goes to the region of its nearer pivot, and to the other as well if that is
  farther by no more than twice the radius: by the triangle inequality, all that is near a
  member is then in the region of that member's pivot.
* In a region, members near the pivot are linked through it. Any other near pair differs from the pivot in common
  shingles, as many as the distances demand, and what only one of them has stays a difference: members with too few common
  or too many own differences leave, and the others join again in cells of their rarest common ones, with pivots of their
  own. Regions lose their pivots each time, so this ends.

Cells of a few members compare them directly, each pair once. No larger group is expanded into pairs, and no link between components is lost.

Shingles are compared by 64-bit hash, sets by 128 bits. Defined results: a null text and
one without words have the empty set, linked with nothing; a text of fewer words than a
shingle has its whole sequence as one; texts are taken whole, however long; equal rows and ties share a
component; a null doc_id names a component only if no other id is in it; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, pick, stored, table, texts_of
from .graph import components

#: Members that a cell compares directly, among sets and where windows narrow the pairs; rows of three sets that a worker holds; words it remembers.
FEW, FEW_NARROW, BATCH, WORDS = 8, 1024, 256, 1 << 18

_ODD, _MIX, _TAG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _TAG
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of the words met last."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: bytes | None, k: int, known: WordHashes) -> np.ndarray:
    """The distinct hashes of all k-word shingles, ascending."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        h = mixed(h * _ODD + each[i : i + n])
    return np.unique(h)


@lru_cache
def size_classes(share: int) -> list[int]:
    """The least sizes of classes such that near sets are in one or in two adjacent ones."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // share + 1)
    return low


def differences(size: int, share: int) -> int:
    """The most elements that one of two near sets of up to ``size`` has and the other hasn't."""
    return 2 * size * (100 - share) // (100 + share)


def block_cells(hashes: np.ndarray, share: int) -> np.ndarray:
    """Cells of a set: for its class of sizes and the next, each block's digest with its place.

    Two sets that have nothing in a block say little by that, so such a cell is cut by a second choice of blocks.
    """
    low = size_classes(share)
    own = int(np.searchsorted(low, len(hashes), side="right")) - 1
    out = []
    for g in (own, own + 1):
        blocks = differences(low[g] * 100 // share, share) + 1
        if blocks > 1:  # else only equal sets are near
            digest, full = _digests(hashes, blocks)
            place = np.arange(1, blocks + 1, dtype=np.uint64) * _ODD + np.uint64(g)
            cells = mixed(digest + place)
            out.append(cells[full])
            if not full.all():
                again, _ = _digests(np.sort(mixed(hashes)), blocks)
                out += [mixed(mixed(again + place) + c) for c in cells[~full]]
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def _digests(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of mixed hashes in each block of ascending hashes, and if it has any."""
    at = np.searchsorted((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32), np.arange(blocks + 1, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes), dtype=np.uint64)])
    return sums[at[1:]] - sums[at[:-1]], at[1:] > at[:-1]


def signed(batches: Iterator[pa.RecordBatch], k: int, share: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, t, text) to (doc_id, t, n, key, cells); key is null for the empty set."""
    import xxhash

    known = WordHashes()
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            n, key, size, cells = [], [], [], []
            for text in texts_of(part):
                h = shingle_hashes(text, k, known)
                n.append(len(h))
                key.append(xxhash.xxh3_128_digest(h) if len(h) else None)
                cells.append(block_cells(h, share) if len(h) else np.zeros(0, np.int64))
                size.append(len(cells[-1]))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(np.concatenate(cells)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), lists], ["doc_id", "t", "n", "key", "cells"])


def sets_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, h): the hashes as bytes."""
    known = WordHashes()
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingle_hashes(x, k, known).tobytes() for x in texts_of(part)], pa.binary())], ["node", "h"])


FOUND = "a long, b long, parent long, q1 long, side int, here boolean, node long, size int, ball boolean, extra int, delta array<long>"


def _differ(x: np.ndarray, y: np.ndarray, share: int) -> tuple[np.ndarray, int, bool]:
    """What one of two sets has and the other hasn't, the size of their union, and if they are near."""
    d = np.setxor1d(x, y, assume_unique=True)
    union = (len(x) + len(y) + len(d)) // 2
    return d, union, 100 * (union - len(d)) >= share * union


def near_pairs(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """The rows (a, b, h, h1) whose sets are near, as links."""
    for batch in batches:
        sets = [[np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(c)] for c in ("h", "h1")]
        near = pa.array([_differ(x, y, share)[2] for x, y in zip(*sets)], pa.bool_())
        yield batch.select(["a", "b"]).filter(near)


def compared(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Rows (parent, q1, q2, node, h, h1, h2) to links (a, b) with a pivot, and to what differs from both pivots, and if that side of the Voronoi boundary is ``here``.

    The first ``extra`` differences are what the pivot hasn't. Distances are fractions of whole numbers; only the windows use floats, with a margin.
    """
    window = 2 * (1 - share / 100) + 1e-9
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("parent", pa.int64()), ("q1", pa.int64()), ("side", pa.int32()), ("here", pa.bool_()), ("node", pa.int64()), ("size", pa.int32()), ("ball", pa.bool_()), ("extra", pa.int32()), ("delta", pa.list_(pa.int64()))])
    for batch in batches:
        out: list[tuple] = []
        for parent, q1, q2, node, *sets in zip(*[batch.column(c).to_pylist() for c in ("parent", "q1", "q2", "node")], *[batch.column(c) for c in ("h", "h1", "h2")]):
            x, *pivots = (np.frombuffer(s.as_buffer(), np.uint64) for s in sets)
            far, near, extra, delta = [], [], [], []
            for q, p in zip((q1, q2), pivots):
                d, union, is_near = _differ(x, p, share)
                far.append(len(d) / union)
                near.append(is_near)
                own = x[np.minimum(np.searchsorted(x, d), len(x) - 1)] == d
                extra.append(int(own.sum()))
                delta.append(np.concatenate([d[own], d[~own]]))
                if is_near and q != node:
                    out.append((node, q, *[None] * 9))
            for side in (0, 1) if node != q2 else ():
                out.append((None, None, parent, q1, side, far[side] <= far[1 - side] + window, node, len(x), near[side], extra[side], delta[side].view(np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows that hold three sets of very long texts go to the workers a few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_pivots(cells: DataFrame) -> DataFrame:
    """(parent, q1, q2, node) of (parent, cell, node, first): members of all cells with the same pivot q1, that of the least ``first``, with another of them."""
    pivots = cells.groupBy("parent", "cell").agg(F.min(F.struct("first", "node"))["node"].alias("q1"))
    members = stored(cells.join(stored(pivots, "pivots"), ["parent", "cell"]).where("node <> q1").select("parent", "q1", "node").distinct(), "members")
    others = members.groupBy("parent", "q1").agg(F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("q2"))
    return members.join(stored(others, "others"), ["parent", "q1"])


def central(cells: DataFrame) -> DataFrame:
    """cells with ``first``: the more cells a node shares with others, the sooner it is a pivot."""
    return cells.join(stored(cells.groupBy("node").agg((-F.count("*")).alias("first")), "central"), "node")


def sized_cells(keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of the cells in ``kept`` (parent, cell, m), with m, written."""
    return stored(keyed.join(stored(kept, "kept"), ["parent", "cell"]), "cells")


def pairs_of(cells: DataFrame, most: int, *more: str) -> DataFrame:
    """Each two members of a cell of ``most`` or less, once a cell, as structs x and y with the columns ``more``."""
    listed = cells.where(F.col("m") <= most).groupBy("parent", "cell").agg(F.sort_array(F.collect_list(F.struct("node", *more))).alias("s"))
    first = listed.select("s", F.posexplode("s").alias("i", "x"))
    return first.select("x", F.explode(F.slice("s", F.col("i") + 2, F.lit(most))).alias("y"))


def finer_cells(found: DataFrame, share: int) -> DataFrame:
    """Cells of regions that aren't done, by the rarest shingles in which members differ from the pivot: (parent, cell, node, m, ball, d, own, allowed)."""
    # where most members lie near the boundary, so that both regions would have them, the region stays whole
    split = found.where("node is not null").groupBy("parent", "q1").agg((F.count_if("here") < 1.5 * F.count_if(F.col("side") == 0)).alias("split"))
    sided = found.where("node is not null").join(stored(split, "split"), ["parent", "q1"]).where("if(split, here, side = 0)")
    members = sided.select(F.xxhash64("parent", "q1", "side").alias("region"), "node", "size", "ball", "extra", "delta")
    open_ = stored(members.groupBy("region").agg(F.count("*").alias("m"), F.bool_and("ball").alias("done"), F.max("size").alias("largest")).where("m > 1 and not done").select("region", "largest"), "open")
    # near sets x, y differ in (100 - share) / (100 + share) of |x| + |y| at most, and neither is larger than the other over the share
    d, allowed = F.size("delta"), F.floor((100 - share) * F.least((F.col("size") + F.col("largest")) / (100 + share), F.col("size") / share) + 1e-9).cast("int")
    opened = stored(members.join(open_, "region").select("region", "node", "ball", d.alias("d"), allowed.alias("allowed"), "extra", "delta"), "opened")
    # what the pivot hasn't comes first: edits of a member alone are mostly there, and who has too many leaves before the others are looked at
    added = stored(opened.select("region", "node", F.explode(F.slice("delta", F.lit(1), F.col("extra"))).alias("e")), "added")
    shared = added.join(stored(shared_by(added), "shared"), ["region", "e"]).groupBy("region", "node").agg(F.count("*").alias("n"))
    left = opened.select("region", "node", "ball", "d", "allowed", "extra").join(stored(shared, "shared"), ["region", "node"], "left")
    left = stored(narrowed(left.select("region", "node", "ball", "d", "allowed", (F.col("extra") - F.coalesce("n", F.lit(0))).cast("int").alias("own"))).select("region", "node"), "left")
    missing = opened.join(left, ["region", "node"]).select("region", "node", F.explode(F.slice("delta", F.col("extra") + 1, F.greatest("d", F.lit(1)))).alias("e"))
    each = stored(added.join(left, ["region", "node"]).select("region", "node", "e").union(missing), "differences")
    kept = each.join(stored(shared_by(each), "common"), ["region", "e"]).groupBy("region", "node").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("s"))
    kept = kept.join(opened.select("region", "node", "d", "allowed", "ball"), ["region", "node"]).withColumn("own", F.col("d") - F.size("s"))
    for _ in range(2):  # what leaves narrows the bounds for the others
        kept = narrowed(stored(kept, "narrowed"))
    prefix = F.transform(F.slice("s", 1, F.size("s") - F.col("least") + 1), lambda x: x["e"])
    keyed = stored(kept.select(F.col("region").alias("parent"), "node", "ball", "d", "own", "allowed", F.explode(prefix).alias("cell")), "finer")
    some = F.bool_or(2 * F.col("own") <= F.col("allowed"))
    return sized_cells(keyed, keyed.groupBy("parent", "cell").agg(F.count("*").alias("m"), F.bool_and("ball").alias("done"), some.alias("some")).where("m > 1 and not done and some").select("parent", "cell", "m"))


def shared_by(differences: DataFrame) -> DataFrame:
    """The differences (region, e) that two or more members have, with their count df."""
    return differences.groupBy("region", "e").agg(F.count("*").alias("df")).where("df > 1")


def narrowed(kept: DataFrame) -> DataFrame:
    """Members (region, node, d, own, allowed, ball) that may be near another one which the pivot doesn't link them to, with ``least``, the differences they must have in common.

    Near members x, y have (d(x) + d(y) - allowed) / 2 differences in common or more, and all own ones of both lie between them.
    So the one with fewer differences has half of ``allowed`` own ones at most, and the other
    no more differences than follows from that (``reach``). One near the pivot only looks for others that aren't.
    ``own`` may be less than all own ones; then fewer leave.
    """
    small = 2 * F.col("own") <= F.col("allowed")
    stats = kept.groupBy("region").agg(F.max(F.when(small, F.col("d") - 2 * F.col("own"))).alias("reach"), F.min(F.when(~F.col("ball"), F.col("d"))).alias("ring"), F.min("d").alias("fewest"), F.min("own").alias("purest"), F.count("*").alias("m"))
    stats = stored(stats.where("m > 1 and reach is not null and ring is not null"), "reach")
    both = kept.drop("least").join(stats, "region")
    half = lambda x: F.ceil((F.col("d") + x - F.col("allowed")) / 2)
    ring = F.greatest(F.col("d") - F.col("allowed") + F.col("purest"), half(F.col("fewest")))
    both = both.withColumn("least", F.greatest(F.lit(1), F.when(F.col("ball"), half(F.col("ring"))).otherwise(ring)).cast("int"))
    may = (F.col("d") - F.col("own") >= F.col("least")) & (F.col("own") + F.col("purest") <= F.col("allowed")) & (small | (F.col("d") - F.col("allowed") <= F.col("reach")))
    return both.where(may).drop("reach", "ring", "fewest", "purest", "m")


def narrow_pairs(cells: DataFrame) -> DataFrame:
    """Pairs (a, b) of small cells of a region that may be near and aren't linked by the pivot."""
    x, y = F.col("x"), F.col("y")
    least = F.least(x["allowed"], y["allowed"])
    common = x["d"] + y["d"] - least  # twice the differences that a near pair has in common at least
    may = ~(x["ball"] & y["ball"]) & (F.abs(x["d"] - y["d"]) <= least) & (x["own"] + y["own"] <= least) & (common <= 2 * F.least(x["d"] - x["own"], y["d"] - y["own"]))
    return pairs_of(cells, FEW_NARROW, "ball", "d", "own", "allowed").where(may).select(x["node"].alias("a"), y["node"].alias("b")).distinct()


def near_sets(docs: DataFrame, *, k: int = 3, share: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (doc_id, text): rows (doc_id, n, key), nodes (node, key, least), and links (a, b) of nodes that join all components."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, n long, key binary, cells array<long>"
    rows = stored(rows.mapInArrow(lambda it: signed(it, k, share), schema), "signed")
    # a row of each set: the least id, and of its rows the least text
    least = rows.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("w"), F.first("cells").alias("cells"))
    nodes = stored(least.select("key", F.col("w.doc_id").alias("least"), F.col("w.t").alias("t"), "cells").withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select(F.lit(0).cast("long").alias("parent"), "node", F.explode("cells").alias("cell"))
    cells = sized_cells(keyed, keyed.groupBy("parent", "cell").agg(F.count("*").alias("m")).where("m > 1"))
    wanted = nodes.join(stored(cells.select("node").distinct(), "wanted"), "node").select("node", "least", "t")
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("least")) & (F.xxhash64("text") == F.col("t")))
    sets = stored(texts.select("node", "text").mapInArrow(lambda it: sets_of(it, k), "node long, h binary").groupBy("node").agg(F.first("h").alias("h")), "sets")

    def with_sets(rows: DataFrame, *at: str) -> DataFrame:
        for c, h in zip(at, ("h", "h1", "h2")):
            rows = rows.join(sets.select(F.col("node").alias(c), F.col("h").alias(h)), c)
        return rows

    pairs = pairs_of(cells, FEW).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    large, links = central(cells.where(F.col("m") > FEW)), []
    while True:
        with small_batches(docs.sparkSession):
            links.append(stored(with_sets(pairs, "a", "b").select("a", "b", "h", "h1").mapInArrow(lambda it: near_pairs(it, share), "a long, b long"), "near"))
            if large.isEmpty():
                break
            rowed = with_sets(with_pivots(large.select("parent", "cell", "node", "first")), "node", "q1", "q2")
            found = stored(rowed.select("parent", "q1", "q2", "node", "h", "h1", "h2").mapInArrow(lambda it: compared(it, share), FOUND), "compared")
        links.append(found.where("a is not null").select("a", "b"))
        cells = finer_cells(found, share)
        # what differs least from the others in its own way lies in their midst
        pairs, large = narrow_pairs(cells), cells.where(F.col("m") > FEW_NARROW).withColumn("first", F.struct("own", "d"))
    return rows.select("doc_id", "n", "key"), nodes.select("node", "key", "least"), reduce(DataFrame.union, links)


def jaccard_components(docs: DataFrame, *, k: int = 3, share: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of (doc_id, text): sets with 100 * intersection >= share * union are linked."""
    rows, nodes, links = near_sets(docs, k=k, share=share)
    roots = components(links).select("node", "root")
    rooted = stored(nodes.join(roots, "node", "left").select("key", "least", F.coalesce("root", "node").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(rooted.join(names, "root").select("key", "component_id"), "labels")
    named = rows.where("key is not null").join(labels, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.union(rows.where("key is null").select("doc_id", "n", "doc_id"))


def op12_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))


#: The same by counting the shingles that each two sets share, and by following links until nothing new is reached.
OP12_SQL = r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS i, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT i, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])) END AS s FROM w),
k AS MATERIALIZED (SELECT i, doc_id, len(s) AS n, sha256(array_to_string(list_sort(s), chr(10))) AS k FROM s),
c AS MATERIALIZED (SELECT min(i) AS i, k, any_value(n) AS n FROM k WHERE n > 0 GROUP BY k),
e AS MATERIALIZED (SELECT i, n, unnest(s) AS x FROM s JOIN c USING (i)),
p AS (SELECT a.i AS a, b.i AS b, any_value(a.n + b.n) AS n, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.i < b.i AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * common >= 90 * (n - common)),
ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS i, a AS j FROM ways UNION SELECT r.i, ways.b FROM r JOIN ways ON ways.a = r.j),
m AS (SELECT k, min(doc_id) AS m FROM k WHERE n > 0 GROUP BY k),
g AS (SELECT c.k, min(m.m) AS g FROM r JOIN c ON c.i = r.i JOIN c d ON d.i = r.j JOIN m ON m.k = d.k GROUP BY 1)
SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.n = 0 THEN k.doc_id ELSE coalesce(g.g, m.m) END AS component_id FROM k LEFT JOIN g ON g.k = k.k AND k.n > 0 LEFT JOIN m ON m.k = k.k AND k.n > 0"""

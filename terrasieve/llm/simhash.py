"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

Fingerprints of 64 bits are cut in b blocks; two that differ in at most d bits agree
on b - d blocks at least, so every choice of b - d blocks is a key. b follows
from the count of different fingerprints, so that keys shared by chance stay a small part
of all; any b finds the same pairs. A key that more than ``TILE`` fingerprints share is cut by the pigeonhole
again, over the bits it leaves open: what is near must agree on two of six blocks of
them. Fingerprints are different, so where ten bits are left open a group is small by
itself, and no group is ever compared whole beyond that size. A tile returns no more
links than join its members, so no group is expanded into all pairs and no link
between components is lost. A pair is taken only under the first key it shares.

Defined results: a null text and one without words have fingerprint zero, which
links like any other; very long texts are taken whole; equal rows and ties share a
component; a null doc_id never names a component unless no other id is in it; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, pick, shielded, stored, table, texts_of
from .graph import components

#: Members of a group that is compared at most, a power of two, and blocks of the open bits of a larger one.
TILE, AGAIN = 1024, 6

#: Tables whose blocks are on disk at a time.
TABLES = 2

#: Keys that a task sorts, about: some 40 MB. More keys take more tasks.
TASK_KEYS = 1 << 20


def fingerprint(text: bytes | None, k: int = 4, seed: int = 42, tables: int = 1) -> list[int]:
    """Bits set in over half the hashes of all k-word shingles, repeats included; further tables mix the hashes anew."""
    import xxhash

    words = (text or b"").translate(LOWER).split()
    if not words:
        return [0] * tables
    hashed, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= k:
        hashes = np.array([hashed(line, seed)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        hashes = np.array([hashed(line[a : b - 1], seed) for a, b in zip([0, *ends], ends[k - 1 :])], np.uint64)
    out = []
    for t in range(tables):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 16):
            x = hashes[i : i + (1 << 16)]
            if t:
                x = (x ^ (x >> np.uint64(31))) * np.uint64(2 * t + 0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
            ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]))
    return out


def fingerprints(docs: DataFrame, k: int = 4, keep: tuple[str, ...] = ("doc_id",), tables: int = 1) -> DataFrame:
    """``keep`` columns and fp, the fingerprint of ``text`` as a signed long; fp1, fp2, ... are those of further tables."""
    names = ["fp", *[f"fp{t}" for t in range(1, tables)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, k, tables=tables) for x in texts_of(batch)], np.uint64).reshape(-1, tables).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(np.ascontiguousarray(x)) for x in fps.T]], [*keep, *names])

    kinds = ", ".join([*[f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep], *[f"{c} long" for c in names]])
    return docs.select(*keep, "text").mapInArrow(run, kinds)


def block_masks(b: int) -> list[int]:
    """The 64 bits in b blocks of nearly equal width."""
    edges = [64 * i // b for i in range(b + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]


def choose_blocks(n: int, distance: int) -> int:
    """The fewest blocks whose keys are so wide that among n fingerprints few share one by chance: one in 256."""
    wide = (b for b in range(distance + 1, distance + 7) if n <= 2 ** (64 * (b - distance) / b) / 256)
    return next(wide, distance + 6)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tile_links(batches: Iterator[pa.RecordBatch], masks: list[int], distance: int, ways: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group (tab, path, key) with fp to links (tab, a, b) that join what is linked inside a group.

    Rows of groups beyond ``TILE`` are passed on as they come, with fp as a and no b, so that no more than a tile is held.
    combo and used come with the rows, or from ``ways`` by path.
    """
    need = len(masks) - distance
    blocks = [np.uint64(m) for m in masks]
    known = [np.array(x, np.int64) for x in zip(*ways)]

    def links(tab: np.ndarray, combo: np.ndarray, sizes: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a_out, b_out, t_out = [], [], []
        fp = np.ascontiguousarray(fp).view(np.uint64)
        at = np.arange(len(fp)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        of = np.repeat(sizes, sizes)
        lag, live = 1, np.flatnonzero(at >= 1)
        while len(live):
            x = fp[live] ^ fp[live - lag]
            near = np.bitwise_count(x) <= distance
            i, x = live[near], x[near]
            shared, taken = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            for q, m in enumerate(blocks):
                use = (x & m == 0) & (taken < need)
                shared |= use.astype(np.int64) << q
                taken += use
            own = i[shared == combo[i]]
            a_out.append(fp[own])
            b_out.append(fp[own - lag])
            t_out.append(tab[own])
            lag += 1
            live = live[(at[live] >= lag) & (of[live] > lag)]
        a, b, t = (np.concatenate(v).tolist() if v else [] for v in (a_out, b_out, t_out))
        root: dict[tuple[int, int], tuple[int, int]] = {}

        def find(v: tuple[int, int]) -> tuple[int, int]:
            while (up := root.get(v, v)) != v:
                root[v] = root.get(up, up)
                v = up
            return v

        kept = []
        for u, v, k in zip(a, b, t):
            ru, rv = find((k, u)), find((k, v))
            if ru != rv:
                root[ru] = rv
                kept.append((k, u, v))
        rows = np.array(kept, np.uint64).reshape(-1, 3).view(np.int64)
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), *[pa.array(np.ascontiguousarray(rows[:, i])) for i in (1, 2)], none.cast(pa.int32()), none, none, none], FOUND)

    def of_batch(batch: pa.RecordBatch) -> list[np.ndarray]:
        tab, path, key, fp = (batch.column(c).to_numpy() for c in ("tab", "path", "key", "fp"))
        combo, used = (batch.column(c).to_numpy() for c in ("combo", "used")) if "combo" in batch.schema.names else (x[path] for x in known)
        return [tab, path, key, combo, used, fp]

    held: list[np.ndarray] | None = None
    over = None  # the group whose first rows were passed on already
    for batch in batches:
        cols = of_batch(batch)
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        tab, path, key, combo, used, fp = cols
        if not len(fp):
            continue
        starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)]))
        sizes = np.diff(np.append(starts, len(fp)))
        large = sizes > TILE
        large[0] |= over == (tab[0], path[0], key[0])
        over, held = ((tab[-1], path[-1], key[-1]), None) if large[-1] else (None, [c[starts[-1] :] for c in cols])
        small = ~large & (sizes > 1)
        small[-1] = False  # the last group may go on in the next batch
        if small.any():
            i = np.repeat(small, sizes)
            yield links(tab[i], combo[i], sizes[small], fp[i])
        if large.any():
            i = np.repeat(large, sizes)
            rest = [pa.array(np.ascontiguousarray(x[i]), t) for x, t in ((combo, pa.int32()), (path, pa.int64()), (used, pa.int64()), (key, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(tab[i]), pa.array(fp[i]), pa.nulls(int(i.sum()), pa.int64()), *rest], FOUND)
    if held is not None and len(held[0]) > 1:
        yield links(held[0], held[3], np.array([len(held[0])]), held[5])


def finer_keys(used: int, distance: int) -> list[int]:
    """Masks of the bits in use and every choice of blocks of the others on which near fingerprints agree."""
    open_ = [i for i in range(64) if not used >> i & 1]
    n = max(AGAIN, distance + 1)
    edges = [len(open_) * i // n for i in range(n + 1)]
    blocks = [sum(1 << i for i in open_[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return [used | sum(c) for c in combinations(blocks, n - distance)]


def split(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (tab, combo, path, used, key, fp) of groups that are too large, to a row for each finer key."""
    masks: dict[int, np.ndarray] = {}
    for batch in batches:
        for i in range(0, batch.num_rows, 1 << 16):
            tab, combo, path, used, fp = (batch.column(c).to_numpy()[i : i + (1 << 16)] for c in ("tab", "combo", "path", "used", "fp"))
            for u in np.unique(used).tolist():
                if u not in masks:
                    masks[u] = np.array(finer_keys(u & (1 << 64) - 1, distance), np.uint64).view(np.int64)
                of, m = used == u, masks[u]
                n = int(of.sum())
                each = np.tile(np.arange(len(m)), n)
                tabs, combos, paths, fps = (np.repeat(x[of], len(m)) for x in (tab, combo, path, fp))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tabs, combos, paths * (len(m) + 1) + each + 1, np.tile(m, n), fps & np.tile(m, n), fps)], KEYED)


KEYED = ["tab", "combo", "path", "used", "key", "fp"]
FOUND = ["tab", "a", "b", "combo", "path", "used", "key"]
COUNTS = "tab int, path long, key long, n long"


def _counted(tab: np.ndarray, path: np.ndarray, key: np.ndarray, least: int) -> pa.RecordBatch:
    """Each key of ``least`` of these rows once, with the number of its rows."""
    order = np.lexsort((key, path, tab))
    cols = [x[order] for x in (tab, path, key)]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
    n = np.diff(np.append(new, len(order)))
    new, n = new[n >= least], n[n >= least]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*[c[new] for c in cols], n)], ["tab", "path", "key", "n"])


def block_counts(batches: Iterator[pa.RecordBatch], masks: list[int], least: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows (tab, fp) to the keys under each mask that ``least`` rows of a batch have, added up inside the batch."""
    for batch in batches:
        tab, fp = (batch.column(c).to_numpy() for c in ("tab", "fp"))
        for path, m in enumerate(masks):
            yield _counted(tab, np.full(len(fp), path, np.int64), fp & np.int64(m), least)


def key_counts(batches: Iterator[pa.RecordBatch], least: int = 1) -> Iterator[pa.RecordBatch]:
    """The same of rows that have their keys already."""
    for batch in batches:
        yield _counted(*[batch.column(c).to_numpy() for c in ("tab", "path", "key")], least)


def near_links(distinct: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Links (tab, a, b) that join all fingerprints of a component in each table; ``distinct`` has each (tab, fp) once.

    Rows move once, to the task of their key, which compares groups of up to ``TILE`` and gives back the rows of
    larger ones to be cut again. Keys that are frequent already inside batches are cut before they move, so that
    none fills a task; which way a group takes doesn't change its links.
    """
    most, rows = distinct.groupBy("tab").count().agg(F.max("count"), F.sum("count")).first()
    b = blocks or choose_blocks(most or 1, distance)
    masks = block_masks(b)
    ways = [(sum(1 << q for q in c), _signed(sum(masks[q] for q in c))) for c in combinations(range(b), b - distance)]
    used, by = [m for _, m in ways], ["tab", "path", "key"]
    of_path = [F.element_at(F.array(*[F.lit(x).cast(t) for x in way]), F.col("path").cast("int") + 1).alias(c) for way, t, c in zip(zip(*ways), ("int", "long"), ("combo", "used"))]
    keyed = distinct.select("tab", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in used])).alias("path", "key")).select("tab", F.col("path").cast("long").alias("path"), "key", "fp")
    counts, n_keys, links = distinct.select("tab", "fp").mapInArrow(lambda it: block_counts(it, used, 2), COUNTS), (rows or 0) * len(used), None
    # a group of 64 - k open bits has 2 ** k members at most, so groups beyond TILE have more than its bits left to cut
    while True:
        heavy = stored(counts.groupBy(*by).agg(F.sum("n").alias("n")).where(F.col("n") > TILE).select(*by), "heavy")
        any_heavy = not heavy.isEmpty()
        light = keyed.join(heavy, by, "left_anti") if any_heavy else keyed
        dealt = light.repartition(n_keys // TASK_KEYS + 1, *by).sortWithinPartitions(*by)
        found = stored(dealt.mapInArrow(lambda it: tile_links(it, masks, distance, ways), "tab int, a long, b long, combo int, path long, used long, key long"), "links")
        near, large = found.where("b is not null").select("tab", "a", "b"), found.where("b is null").withColumnRenamed("a", "fp").select(*KEYED)
        links = near if links is None else links.union(near)
        if any_heavy:
            rest = keyed.join(heavy, by)
            large = large.union((rest if "combo" in rest.columns else rest.select("*", *of_path)).select(*KEYED))
        elif large.isEmpty():
            return links
        keyed = stored(large.mapInArrow(lambda it: split(it, distance), "tab int, combo int, path long, used long, key long, fp long"), "finer-keys")
        counts, n_keys = keyed.select(*by).mapInArrow(lambda it: key_counts(it, 2), COUNTS), keyed.count()


def group(fps: DataFrame, distance: int = 4, tables: int = 1) -> DataFrame:
    """fps (doc_id, fp and others) with root, the same for all fingerprints of a component, and component_id, the smallest doc_id reachable.

    What is near in any table is linked. The first table's fingerprints are the nodes: each of another
    table stands for the least node that has it.
    """
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    if tables == 1:
        edges = near_links(distinct.select(F.lit(0).alias("tab"), "fp"), distance).select("a", "b")
    else:
        each = F.posexplode(F.array("fp", *[f"fp{t}" for t in range(1, tables)])).alias("tab", "other")
        seen = stored(fps.select("fp", each).distinct(), "tables")
        node = stored(seen.groupBy("tab", "other").agg(F.min("fp").alias("node")), "nodes")
        # a few tables after the others: their rows of blocks are let go before those of the next are made
        some = [node.where(F.col("tab").between(t, t + TABLES - 1)).select("tab", F.col("other").alias("fp")) for t in range(0, tables, TABLES)]
        links = reduce(DataFrame.union, [near_links(x, distance) for x in some])
        for end in ("a", "b"):
            links = links.join(node.select("tab", F.col("other").alias(end), F.col("node").alias(f"node_{end}")), ["tab", end])
        same = seen.join(node, ["tab", "other"]).where("fp <> node").select("fp", "node")
        edges = links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).union(same)
    roots = components(edges)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(stored(rooted.join(names, "root").select("fp", "root", "component_id"), "labels"), "fp")


def near_duplicates(docs: DataFrame, *, k: int = 4, distance: int = 4, tables: int = 1) -> DataFrame:
    """doc_id, fp, root and component_id of (doc_id, text)."""
    return group(stored(fingerprints(docs, k, tables=tables), "fingerprints"), distance, tables)


def keep_first(docs: DataFrame, *, k: int = 2, distance: int = 4, tables: int = 8) -> DataFrame:
    """One row of docs for each component: that of the least doc_id (a null id last, then the least text hash).

    Texts that share 0.8 of their five-word shingles differ in some ten bits of a fingerprint over such
    shingles, which no choice of blocks can find. Over two-word shingles they differ in some five, so that
    one of several independent tables has them within four: nine of ten are found, and unrelated texts aren't.
    """
    docs, restore = shielded(docs, "doc_id", "text")
    keyed = docs.withColumn("t_", F.xxhash64("text"))
    fps = group(stored(fingerprints(keyed, k, ("doc_id", "t_"), tables), "fingerprints"), distance, tables)
    first = fps.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t_")).alias("w")).select(F.col("w.doc_id").alias("w_id"), F.col("w.t_").alias("w_t"))
    # of repeated rows one stays: they are told apart by number in the narrow table, not by moving texts again
    rows = keyed.join(first, keyed["t_"].eqNullSafe(first["w_t"]) & keyed["doc_id"].eqNullSafe(first["w_id"])).drop("w_id", "w_t")
    again = fps.groupBy("doc_id", "t_").agg(F.count("*").alias("n_")).where("n_ > 1")
    if again.isEmpty():
        return restore(rows)
    numbered = rows.withColumn("n_", F.row_number().over(W.partitionBy("doc_id", "t_").orderBy("doc_id")))
    return restore(numbered.where("n_ = 1"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Prefix trie of conversations whose first turns are shared.

Conversations become a row each: 16 bytes of digest and a length a turn, so texts don't
move. Equal conversations become one path with a multiplicity. Paths are dealt to
buckets by the digest of their first turn, and ``applyInPandas`` builds the tries of a
bucket with a dictionary of pointers; children are numbered after their parents, so one
walk from the last number to the first is the postorder. A first turn with more turns
below it than ``most`` is cut by the next turn, again and again until all parts fit or are one path;
the nodes cut off get their sums from those of their children, last cut first. What a
node's conversations are is put in order by ranges and hashed in pieces, so no list of
ids is held whole.

Defined results: rows with a null conv_id belong to no conversation; turns go by number
(null first), and turns of one number by their digest; a repeated turn counts
twice; null role or text is empty; a conversation without turns is a member of the
root alone; very long texts count whole; a very long conversation is one array of
some 20 bytes a turn; an empty table gives no rows, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, stored, table

#: Turns below a prefix from which it is cut by the next turn, and turns that a bucket of tries holds, about.
MOST, BUCKET = 1 << 17, 1 << 15

#: Bytes of ids in a piece, bytes of a turn's digest, the hash of nothing.
PIECE, WIDE, NOTHING = 1 << 16, 16, hashlib.sha256().hexdigest()

NODES = "depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, cut binary"


def turn_digest(role: str = "role", text: str = "text") -> Column:
    """128 bits of the turn, role and text told apart by the role's length."""
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    return F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(r).cast("string"), F.concat(r, t)).cast("binary"), 256)), 1, WIDE)


def own_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, own): the turns of each conversation in order, as structs with d and n."""
    one = F.struct("turn", turn_digest().alias("d"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    listed = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("own"))
    return listed.select("conv_id", F.transform("own", lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n"))).alias("own"))


def shared_heads(own: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, own) with the first turns taken from the conversation that begins each hundred, by crc32 of the id some 0 to ``most`` - 1."""
    base = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    head = F.coalesce(F.slice("head", 1, h), F.expr("cast(array() as array<struct<d: binary, n: int>>)"))
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    return both.select("conv_id", F.concat(head, rest).alias("own"))


def as_paths(own: DataFrame) -> DataFrame:
    """(conv_id, path, lens, k): digests end to end, lengths, and the digest of the whole path."""
    path = F.unhex(F.array_join(F.transform("own", lambda x: F.hex(x["d"])), ""))
    return own.select("conv_id", path.alias("path"), F.transform("own", lambda x: x["n"]).alias("lens")).withColumn("k", F.unhex(F.sha2("path", 256)))


def id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, conv_id) in order to pieces (k, first, n, ids) of some ``PIECE`` bytes, ids comma-joined."""
    k, held, size = None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.binary()), pa.array([int(held[0])]), pa.array([len(held)]), pa.array([",".join(held)])], ["k", "first", "n", "ids"])

    for batch in batches:
        for key, conv in zip(batch.column("k").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (key != k or size > PIECE):
                yield piece()
                held, size = [], 0
            k = key
            held.append(str(conv))
            size += len(held[-1]) + 1
    if held:
        yield piece()


def hashed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to (k, conv_id, n, ends): the least id, the number of ids and the hash of them all."""
    k, first, n, h = None, 0, 0, None
    for batch in batches:
        out = []
        for key, one, count, ids in zip(*[batch.column(c).to_pylist() for c in ("k", "first", "n", "ids")]):
            if h is None or key != k:
                if h is not None:
                    out.append((k, first, n, h.hexdigest()))
                k, first, n, h = key, one, 0, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
            n += count
        if out:
            yield _ends(out)
    if h is not None:
        yield _ends([(k, first, n, h.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    k, first, n, ends = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(ends)], ["k", "conv_id", "n", "ends"])


def distinct_paths(convs: DataFrame) -> DataFrame:
    """(conv_id, n, ends, path, lens): each path once, with its least conversation, how many there are and the hash of their ids."""
    pieces = convs.select("k", "conv_id").repartitionByRange("k", "conv_id").sortWithinPartitions("k", "conv_id").mapInArrow(id_pieces, "k binary, first long, n long, ids string")
    ends = stored(pieces.repartition("k").sortWithinPartitions("k", "first").mapInArrow(hashed_pieces, "k binary, conv_id long, n long, ends string"), "ends")
    return convs.join(ends, ["conv_id", "k"]).select("conv_id", "n", "ends", "path", "lens")


def grow(rows: pd.DataFrame) -> pd.DataFrame:
    """The tries of a bucket of paths, a row a node; ``cut`` names the node above for the topmost ones.

    Rows have cut, depth (of the node above), parent_conv_id (its least member), and the path of which ``depth`` turns are above.
    """
    rows = rows.sort_values("conv_id")
    child: dict[tuple, int] = {}
    up, depth, conv, above, n_convs, size, ends, cut = [], [], [], [], [], [], [], []
    for c, n, sha, path, lens, d, top, top_conv in zip(*[rows[x] for x in ("conv_id", "n", "ends", "path", "lens", "depth", "cut", "parent_conv_id")]):
        at: int | bytes = top
        for i in range(d, len(path) // WIDE):
            key = (at, path[i * WIDE : (i + 1) * WIDE])
            node = child.get(key)
            if node is None:
                node = child[key] = len(up)
                first = i == d
                up.append(-1 if first else at)
                cut.append(top if first else None)
                above.append(top_conv if first else conv[at])
                depth.append(i + 1)
                conv.append(c)
                size.append(int(lens[i]))
                n_convs.append(0)
                ends.append(NOTHING)
            n_convs[node] += n
            at = node
        ends[at] = sha
    children, leaves, saved = [0] * len(up), [0] * len(up), [0] * len(up)
    for node in range(len(up) - 1, -1, -1):
        leaves[node] += not children[node]
        saved[node] += (n_convs[node] - 1) * size[node]
        if (p := up[node]) >= 0:
            children[p] += 1
            leaves[p] += leaves[node]
            saved[p] += saved[node]
    return pd.DataFrame({"depth": np.array(depth, np.int32), "conv_id": np.array(conv, np.int64), "parent_conv_id": np.array(above, np.int64), "n_convs": np.array(n_convs, np.int64), "n_children": np.array(children, np.int64), "n_leaves": np.array(leaves, np.int64), "saved_tokens": np.array(saved, np.int64), "ends_sha256": pd.Series(ends, dtype=object), "cut": pd.Series(cut, dtype=object)})


def trie(paths: DataFrame, *, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """A row a node (``NODES`` without cut) of the trie over distinct paths; no rows for no paths."""
    spark = paths.sparkSession
    paths = stored(paths, "paths")
    total = paths.agg(F.min("conv_id").alias("c"), F.sum("n").alias("n"), F.max(F.when(F.length("path") == 0, F.col("ends"))).alias("ends"), F.sum(F.size("lens")).alias("turns")).first()
    if total["c"] is None:
        return spark.createDataFrame([], NODES).drop("cut")
    left, turns = F.substring("path", F.col("depth") * WIDE + 1, WIDE), F.size("lens") - F.col("depth")
    root = F.lit(b"").cast("binary")
    spines = [spark.createDataFrame([(b"", None, 0, total["c"], None, total["n"], 0, total["ends"] or NOTHING)], "id binary, cut binary, depth int, conv_id long, parent_conv_id long, n long, size int, ends string")]
    rows = paths.where("size(lens) > 0").withColumns({"cut": root, "depth": F.lit(0), "parent_conv_id": F.lit(total["c"]).cast("long")})
    fit, columns = [], ["cut", "depth", "parent_conv_id", "conv_id", "n", "ends", "path", "lens"]
    while True:
        # all that share the next turn, too, and what would become their node
        here = F.size("lens") == F.col("depth") + 1
        size = F.element_at("lens", F.col("depth") + 1)
        groups = rows.groupBy("cut", "depth", "parent_conv_id", left.alias("next")).agg(F.min("conv_id").alias("least"), F.sum("n").alias("members"), F.sum(turns).alias("turns"), F.count("*").alias("paths"), F.max(size).alias("size"), F.max(F.when(here, F.col("ends"))).alias("own_ends"))
        large = stored(groups.where((F.col("turns") > most) & (F.col("paths") > 1)).withColumn("id", F.unhex(F.sha2(F.concat("cut", "next"), 256))), "large")
        if large.isEmpty():
            fit.append(rows.select(*columns))
            break
        spines.append(large.select("id", "cut", (F.col("depth") + 1).alias("depth"), F.col("least").alias("conv_id"), "parent_conv_id", F.col("members").alias("n"), "size", F.coalesce("own_ends", F.lit(NOTHING)).alias("ends")))
        mark = large.select("cut", "next", "id", "least")
        marked = stored(rows.withColumn("next", left).join(mark, ["cut", "next"], "left"), "marked")
        fit.append(marked.where("id is null").select(*columns))
        rows = marked.where((F.col("id").isNotNull()) & ~here).select(F.col("id").alias("cut"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent_conv_id"), "conv_id", "n", "ends", "path", "lens")
    every = fit[0]
    for x in fit[1:]:
        every = every.union(x)
    deal = F.pmod(F.xxhash64("cut", left), F.lit(int(total["turns"]) // bucket + 1)).alias("bucket")
    grown = stored(every.groupBy(deal).applyInPandas(lambda rows: grow(rows), NODES), "tries")
    sums = F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    out, below = grown, grown.where("cut is not null").select("cut", "n_leaves", "saved_tokens")
    for spine in reversed(spines):
        kids = below.groupBy(F.col("cut").alias("id")).agg(*sums)
        saved = (F.col("n") - 1) * F.col("size") + F.coalesce("saved", F.lit(0))
        nodes = spine.join(kids, "id", "left").select("depth", "conv_id", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"), F.col("ends").alias("ends_sha256"), "cut")
        nodes = stored(nodes, "spine")
        out, below = out.unionByName(nodes), below.unionByName(nodes.where("cut is not null").select("cut", "n_leaves", "saved_tokens"))
    return out.drop("cut")


def conversation_trie(turns: DataFrame, *, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """Nodes of the trie over (conv_id, turn, role, text) with shared heads."""
    own = stored(own_turns(turns), "conversations")
    return trie(distinct_paths(stored(as_paths(shared_heads(own)), "rebuilt")), most=most, bucket=bucket)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = conversation_trie(pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"))
    return nodes.select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], "ends_sha256")


#: crc32 of the digits of conv_id, bit by bit: each digit is followed by eight steps of the polynomial.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"

#: The same by lists of turns: every prefix is a group, and a node adds to all its own prefixes.
OP13_SQL = f"""WITH t AS (SELECT conv_id, turn, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS own FROM t GROUP BY 1),
h AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, CAST({_CRC} % 6 AS BIGINT) AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:len(h.own)]) AS p FROM h LEFT JOIN o b ON b.conv_id = h.base),
m AS (SELECT conv_id, p, unnest(range(len(p) + 1)) AS d FROM r),
nodes AS (SELECT p[1:d] AS pre, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(p) = d), '') AS e, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * any_value(p[d].n) END AS own FROM m GROUP BY 1, 2),
kids AS (SELECT pre[1:d - 1] AS pre, count(*) AS c FROM nodes WHERE d > 0 GROUP BY 1),
known AS (SELECT nodes.*, coalesce(c, 0) AS c FROM nodes LEFT JOIN kids USING (pre)),
ups AS (SELECT pre, own, c, unnest(range(d + 1)) AS u FROM known),
sums AS (SELECT pre[1:u] AS pre, count(*) FILTER (c = 0) AS leaves, sum(own) AS saved FROM ups GROUP BY 1)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, x.c AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(x.e) AS ends_sha256
FROM known x JOIN sums USING (pre) LEFT JOIN nodes y ON x.d > 0 AND y.pre = x.pre[1:x.d - 1]"""

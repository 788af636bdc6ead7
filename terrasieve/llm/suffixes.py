"""Benchmark decontamination with suffix arrays of the training shards.

Each task sorts the word suffixes of its documents, some megabytes of text at a
time (a shard), and binary-searches every suffix of every benchmark item in each
shard's array. Words are numbered by the benchmark's vocabulary; a word outside it
is 0 and ends any match, so suffixes that reach one before the shortest window ends
match nothing and stay out of the array.

The benchmark is broadcast in blocks of bounded bytes, one pass over the documents
for each block, so nothing that is broadcast grows beyond that bound.

The longest verbatim match of each item in each document is kept with its places:
windows found one after another on a diagonal of document and item are one match.

Defined results: a null or wordless document has no words and is clean; a very long one
is a shard of its own; a null or wordless item is never found; repeated items each count,
and of equally long matches of an item the first in the document is kept; an empty benchmark
leaves all documents clean and an empty documents table gives no rows; repeated documents
are each reported; extra columns are ignored by the report and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, pick, shielded, stored, table, texts_of

#: Bytes outside [0-9A-Za-z\x80-\xff] become spaces, A-Z become a-z.
WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in LOWER)

#: Bytes of text under one suffix array, and of benchmark text in one broadcast.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


@dataclass
class Benchmark:
    """Word numbers of the items, end to end with a 0 after each, and their windows."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray
    starts: np.ndarray
    names: list[str]
    lengths: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str, bytes | None]]) -> Benchmark:
        vocabulary: dict[bytes, int] = {}
        flat, starts, names, lengths = [], [], [], []
        for name, text in items:
            if words := words_of(text):
                names.append(name)
                starts.append(len(flat))
                lengths.append(len(words))
                flat += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
                flat.append(0)
        return cls(vocabulary, np.array(flat, np.int64), np.array(starts, np.int64), names, np.array(lengths, np.int64))

    def suffixes(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every suffix that holds a window: item, position and window length."""
        item = np.repeat(np.arange(len(self.names)), np.maximum(1, self.lengths - window + 1))
        first = np.cumsum(np.maximum(1, self.lengths - window + 1)) - np.maximum(1, self.lengths - window + 1)
        at = self.starts[item] + np.arange(len(item)) - first[item]
        return item, at, np.minimum(window, self.lengths[item])


def packed_columns(ids: np.ndarray, at: np.ndarray, words: int, base: int) -> list[np.ndarray]:
    """The words from each position as numbers in the given base, several to a 63-bit column."""
    each = max(1, int(62 // np.log2(base + 1)))
    padded = np.concatenate([ids, np.zeros(words + each, np.int64)])
    out = []
    for a in range(0, words, each):
        key = np.zeros(len(at), np.int64)
        for k in range(a, a + each):
            key = key * base + (padded[at + k] if k < words else 0)
        out.append(key)
    return out


def suffix_array(ids: np.ndarray, at: np.ndarray, depth: int, base: int) -> np.ndarray:
    """The positions in order of the words that follow, to a depth; only ties are refined."""
    each = max(1, int(62 // np.log2(base + 1)))
    key = packed_columns(ids, at, each, base)[0]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    tie = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.zeros(0, bool)
    done = each
    while done < depth and tie.any():
        rows = np.flatnonzero(tie | np.concatenate([tie[1:], [False]]))
        group = np.cumsum(~tie)[rows]
        live = at[rows] + done
        nxt = packed_columns(ids, np.minimum(live, len(ids)), each, base)[0]
        order = np.lexsort((nxt, group))
        at[rows] = at[rows][order]
        nxt = nxt[order]
        same = np.concatenate([[False], (nxt[1:] == nxt[:-1]) & (group[1:] == group[:-1]) & (nxt[1:] != 0)])
        tie = np.zeros(len(at), bool)
        tie[rows] = same
        done += each
    return at


def bisect(columns: list[np.ndarray], queries: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of rows of ``queries`` in the sorted rows of ``columns``, all steps together."""
    n, m = len(columns[0]), len(queries[0])
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) >> 1
        less, equal = np.zeros(len(live), bool), np.ones(len(live), bool)
        for c, q in zip(columns, queries):
            a, b = c[mid], q[live]
            less |= equal & (a < b)
            equal &= a == b
        go = less | equal if right else less
        lo[live[go]] = mid[go] + 1
        hi[live[~go]] = mid[~go]
    return lo


class Shard:
    """Documents of one suffix array and what was found in them."""

    def __init__(self, benchmark: Benchmark, window: int):
        self.b, self.window = benchmark, window
        self.item, self.at, self.width = benchmark.suffixes(window)
        self.base = len(benchmark.vocabulary) + 2
        self.least = int(self.width.min()) if len(self.width) else 1
        # windows of the same words are searched once; shorter ones are padded with the least and the greatest number
        keep = np.arange(window)[None, :] < self.width[:, None]
        grid = benchmark.ids[np.minimum(self.at[:, None] + np.arange(window)[None, :], max(0, len(benchmark.ids) - 1))] if len(self.at) else np.zeros((0, window), np.int64)
        grid = np.where(keep, grid, -1).astype(np.int32)
        rows, self.which = np.unique(grid, axis=0, return_inverse=True)
        self.which = self.which.reshape(-1)
        self.wide = (rows >= 0).sum(1)
        flat, at = np.where(rows >= 0, rows, 0).reshape(-1), np.arange(len(rows)) * window
        high = np.where(rows >= 0, rows, self.base - 1).reshape(-1)
        self.low, self.high = packed_columns(flat, at, window, self.base), packed_columns(high, at, window, self.base)
        self.order = np.argsort(self.which, kind="stable")  # suffixes by window; those of window w begin at off[w]
        self.off = np.concatenate([[0], np.cumsum(np.bincount(self.which, minlength=len(rows)))]).astype(np.int64)

    def _suffixes(self, window: int) -> np.ndarray:
        return self.order[self.off[window] : self.off[window + 1]]

    def search(self, docs: list[list[bytes]], longest: bool) -> list[tuple[list[int], np.ndarray, list[tuple[int, int, int, int]]]]:
        """For each document: ranges of words hit (begin, end, begin, ...), items found, and with ``longest`` the longest match of each item as (item, item word, doc word, words)."""
        lengths = np.array([len(d) for d in docs], np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        ids = np.zeros(int((lengths + 1).sum()), np.int64)
        get = self.b.vocabulary.get
        for s, d in zip(starts.tolist(), docs):
            ids[s : s + len(d)] = [get(w, 0) for w in d]
        # words from each position on before the next 0
        zero = np.flatnonzero(ids == 0)
        ahead = np.repeat(zero, np.diff(zero, prepend=-1)) - np.arange(len(ids))
        sa = suffix_array(ids, np.flatnonzero(ahead >= self.least), self.window, self.base)
        found: list[tuple[list[int], np.ndarray, list]] = [([], np.zeros(0, np.int64), []) for _ in docs]
        if not len(sa) or not len(self.wide):
            return found
        columns = packed_columns(ids, sa, self.window, self.base)
        a, b = bisect(columns, self.low, False), bisect(columns, self.high, True)
        hits = b - a
        window = np.repeat(np.arange(len(hits)), hits)
        pos = sa[np.repeat(a, hits) + np.arange(len(window)) - np.repeat(np.cumsum(hits) - hits, hits)]
        if not len(pos):
            return found
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, pos, 1)
        np.add.at(edge, pos + self.wide[window], -1)
        hit = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)])
        turns = np.flatnonzero(np.diff(hit))  # begins and ends in turn; the 0 between documents parts them
        doc = np.searchsorted(starts, pos, side="right") - 1
        order = np.argsort(doc, kind="stable")
        cuts = np.flatnonzero(np.diff(doc[order], prepend=-1))
        best = self._longest(doc, starts, pos, window) if longest else {}
        for rows in np.split(order, cuts[1:]):
            d = int(doc[rows[0]])
            items = np.unique(np.concatenate([self.item[self._suffixes(w)] for w in np.unique(window[rows]).tolist()]))
            lo, hi = np.searchsorted(turns, [starts[d], starts[d] + lengths[d] + 1])
            found[d] = ((turns[lo:hi] - starts[d]).tolist(), items, best.get(d, []))
        return found

    def _longest(self, doc: np.ndarray, starts: np.ndarray, pos: np.ndarray, window: np.ndarray) -> dict[int, list[tuple[int, int, int, int]]]:
        """Of each document and item the longest verbatim match (item, item word, doc word, words): a stretch of windows found along a diagonal."""
        times = np.diff(self.off)[window]
        suffix = self.order[np.repeat(self.off[window], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
        p, d, item, at, wide = np.repeat(pos, times), np.repeat(doc, times), self.item[suffix], self.at[suffix], self.width[suffix]
        order = np.lexsort((p, p - at, item, d))
        p, d, item, at, wide = (x[order] for x in (p, d, item, at, wide))
        same = (d[1:] == d[:-1]) & (item[1:] == item[:-1]) & (p[1:] == p[:-1] + 1) & (at[1:] == at[:-1] + 1)
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        words = np.diff(np.append(first, len(p))) - 1 + wide[first]
        p, d, item, at = p[first], d[first], item[first], at[first]
        order = np.lexsort((p, -words, item, d))
        keep = order[np.concatenate([[True], (d[order][1:] != d[order][:-1]) | (item[order][1:] != item[order][:-1])])]
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        for k, i, a, b, n in zip(d[keep].tolist(), item[keep].tolist(), (at - self.b.starts[item])[keep].tolist(), (p - starts[d])[keep].tolist(), words[keep].tolist()):
            out.setdefault(k, []).append((i, a, b, n))
        return out


def blocks_of(items: DataFrame, limit: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """(item_id, text) a block at a time: the driver holds one block of ``limit`` bytes, or one item."""
    held: list[tuple[str | None, bytes | None]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        n = len(row[1] or b"")
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((row[0], bytes(row[1]) if row[1] is not None else None))
        size += n
    yield held


def merged(a: list[int], b: list[int]) -> list[int]:
    """The union of two lists of ranges."""
    out: list[int] = []
    for lo, hi in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("item_word", "doc_word", "words")]]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("hit", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", MATCHES)]


def find(docs: DataFrame, items: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), window: int = 10, longest: bool = True, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``keep`` columns of docs with n_words, hit (ranges of words), items (ids) and matches (the longest of each item).

    One pass for each benchmark block; between passes the rows are written to the shared folder.
    """
    text, rows = docs.schema["text"], docs
    blocks = blocks_of(items, block_bytes)
    block, first = next(blocks), True
    while block is not None:
        after = next(blocks, None)
        out = [*[docs.schema[c] for c in keep], *([text] if after is not None and "text" not in keep else []), *FOUND]
        rows = _pass(rows, block, T.StructType(out), first, window, longest, shard_bytes)
        if after is not None:
            rows = stored(rows, "suffix-pass")
        block, first = after, False
    return rows


def _pass(rows: DataFrame, block: list, schema: T.StructType, first: bool, window: int, longest: bool, shard_bytes: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Benchmark.of(block))
    plain = [c for c in schema.names if c not in ("n_words", "hit", "items", "matches")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, b = Shard(shared.value, window), shared.value
        for batch in batches:
            lo, size, words = 0, 0, []
            for i, x in enumerate(texts_of(batch)):
                words.append(words_of(x))
                size += len(x or b"")
                if size >= shard_bytes or i + 1 == batch.num_rows:
                    part = batch.slice(lo, i + 1 - lo)
                    found = shard.search(words, longest)
                    new = [
                        [len(w) for w in words],
                        [x[0] for x in found],
                        [sorted({b.names[k] for k in x[1].tolist() if b.names[k] is not None}) for x in found],
                        [[{"item_id": b.names[m[0]], "item_word": m[1], "doc_word": m[2], "words": m[3]} for m in x[2]] for x in found],
                    ]
                    if not first:
                        had = [part.column(c).to_pylist() for c in ("hit", "items", "matches")]
                        new[1] = [merged(x, y) for x, y in zip(had[0], new[1])]
                        new[2] = [sorted({*x, *y}) for x, y in zip(had[1], new[2])]
                        new[3] = [x + y for x, y in zip(had[2], new[3])]
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in plain], *[pa.array(v, k) for v, k in zip(new, kinds)]], schema.names)
                    lo, size, words = i + 1, 0, []

    needed = list(dict.fromkeys([*plain, "text", *([] if first else ["hit", "items", "matches"])]))
    return rows.select(*needed).mapInArrow(run, schema)


def n_hit(hit: str = "hit") -> Column:
    return F.aggregate(F.transform(hit, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)


def report(docs: DataFrame, items: DataFrame, *, window: int = 10, longest: bool = False, **options: int) -> DataFrame:
    """The digest of each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and with ``longest`` the matches."""
    return find(docs, items, window=window, longest=longest, **options).select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"), *["matches"] * longest
    )


def clean(docs: DataFrame, items: DataFrame, *, window: int = 10, **options: int) -> DataFrame:
    """The documents that hold no window of any item, with all their columns."""
    docs, restore = shielded(docs, "doc_id", "text")
    return restore(find(docs, items, keep=tuple(docs.columns), window=window, longest=False, **options).where(F.size("hit") == 0))


def op1_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), pick(table(spark, sf_dir, "benchmark"), "item_id", "text"), longest=True)

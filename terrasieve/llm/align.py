"""Line dedup by pairwise alignment.

A block is covered by its least windows: runs of lines that hold ``min_words`` words and
lose that without their first or their last line. Documents meet on equal windows, so
short lines count together. Each is paired with the first holder (by doc_id) of every
window, so a window held by n documents gives n - 1 pairs. Each pair is aligned by
patience diff on line hashes, with a longest common subsequence where no line is unique,
and the common blocks of some words or more are deleted from the later document. Windows
that this leaves in place meet their other earlier holders, 8 times as many a round, until
they are deleted or no holder is left. Holders whose lines look the same to all documents
still open (lines none of those has are alike) align alike, so the first of them stands
for all. A deleted block always stays in the first document that holds it.

Lines are parted by ``\\n`` and compared by 64-bit hash after trailing white space is
cut. Defined results: null and empty texts have no lines to delete and stay as they
are; blank lines are never anchors; documents of equal lines lose all of them but in the
first; rows with the same doc_id and text count as one document, so neither loses lines
to the other; null ids come first in order; very long texts are taken whole; an empty table
gives no rows; extra columns are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, shielded, stored, table

#: A block of fewer words stays.
MIN_WORDS = 5
#: Holders of a window that are met in a round, as a multiple of those of the round before.
MORE = 8


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, a row of bits a line of a; every k-th row is held and those between made again."""
    full = (1 << len(b)) - 1
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    step = lambda v, x: (v + (u := v & at.get(x, 0)) | v - u) & full
    k = max(1, int(len(a) ** 0.5))
    held, v = [full], full
    for i, x in enumerate(a, 1):
        v = step(v, x)
        if i % k == 0:
            held.append(v)
    out, i, j, low, rows = [], len(a), len(b), -1, []
    while i and j:
        if (i - 1) // k != low:
            low = (i - 1) // k
            rows = [held[low]]
            for x in a[low * k : low * k + k]:
                rows.append(step(rows[-1], x))
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i - low * k] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def patience(a: list[int], b: list[int], blank: frozenset[int] = frozenset()) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b): unique common lines in longest increasing order, their equal neighbours, then what lies between, again; a longest common subsequence where no line is unique."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a.get(x) == 1 and x not in blank}
        pairs = [(i, at[x]) for i, x in enumerate(a[a0:a1], a0) if x in at]
        if pairs:
            tails: list[int] = []  # the least last position in b of a chain of each length
            ends: list[int] = []
            before = [-1] * len(pairs)
            for k, (_, j) in enumerate(pairs):
                n = bisect_left(tails, j)
                before[k] = ends[n - 1] if n else -1
                tails[n : n + 1], ends[n : n + 1] = [j], [k]
            chain, k = [], ends[-1]
            while k >= 0:
                chain.append(pairs[k])
                k = before[k]
            chain.reverse()
        else:
            of_a = [i for i in range(a0, a1) if a[i] in in_b and a[i] not in blank]
            of_b = [j for j in range(b0, b1) if b[j] in in_a and b[j] not in blank]
            if not of_a:
                continue
            chain = [(of_a[i], of_b[j]) for i, j in longest_common([a[i] for i in of_a], [b[j] for j in of_b])]
        i0, j0 = a0, b0
        for i, j in [*chain, (a1, b1)]:
            todo.append((i0, i, j0, j))
            if (i, j) != (a1, b1):
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Ranges of lines of b in blocks aligned with a; ``words`` counts those of each line of b."""
    blank = frozenset(x for x, n in zip(b, words) if not n)
    out, run = [], []
    for i, j in [*patience(a, b, blank), (-1, -1)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[k] for _, k in run) >= min_words:
                out.append((run[0][1], run[-1][1] + 1))
            run = []
        run.append((i, j))
    return out


def windows(lines: np.ndarray, words: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """Document, hash, first line and end of the least windows of documents end to end; ``ends`` are theirs."""
    n, least = len(lines), max(min_words, 1)
    c = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    every = np.arange(n)
    ahead, back = np.searchsorted(c, c[:-1] + least), np.searchsorted(c, c[1:] - least, side="right") - 1
    lo, hi = np.concatenate([every, back]), np.concatenate([ahead, every + 1])
    of = np.concatenate([doc, doc])
    inside = (lo >= (ends - np.diff(ends, prepend=0))[of]) & (hi <= ends[of])
    lo, hi = np.divmod(np.unique(lo[inside] * (n + 1) + hi[inside]), n + 1)
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up = np.cumprod(np.full(n + 1, base, np.uint64))
        down = np.cumprod(np.full(n + 1, inverse, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.astype(np.int64).view(np.uint64) * up[:n], dtype=np.uint64)])
        hashes = (sums[hi] - sums[lo]) * down[lo]
    at = doc[lo] if n else lo
    first = (ends - np.diff(ends, prepend=0))[at]
    return at, hashes.view(np.int64), lo - first, hi - first


def each_window(reps: DataFrame, min_words: int) -> DataFrame:
    """(d, lines, words) to d, w, lo and hi: a row a window."""
    kind = reps.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                lines, words = part.column("lines"), part.column("words")
                ends = np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False))
                at, w, lo, hi = windows(lines.flatten().to_numpy(zero_copy_only=False), words.flatten().to_numpy(zero_copy_only=False), ends, min_words)
                yield pa.RecordBatch.from_arrays([part.column("d").take(pa.array(at)), pa.array(w), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["d", "w", "lo", "hi"])

    return reps.select("d", "lines", "words").mapInArrow(run, f"d {kind}, w long, lo int, hi int")


def align_pairs(pairs: DataFrame, reps: DataFrame, min_words: int) -> DataFrame:
    """(d, a) to d and blocks: ranges of lines of d that are aligned with a."""
    first = pairs.join(reps.select(F.col("d").alias("a"), F.col("lines").alias("a_lines")), "a").select("d", "a_lines")
    both = first.join(reps.select("d", "lines", "words"), "d")
    kind = reps.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [common_blocks(a.as_py(), b.as_py(), w.as_py(), min_words) for a, b, w in zip(*[batch.column(c) for c in ("a_lines", "lines", "words")])]
            blocks = pa.array([[{"lo": lo, "hi": hi} for lo, hi in x] for x in found], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("d"), blocks], ["d", "blocks"])

    found = both.select("d", "a_lines", "lines", "words").mapInArrow(run, f"d {kind}, blocks array<struct<lo:int,hi:int>>")
    return found.where(F.size("blocks") > 0)


def still_open(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Windows (d, w, lo, hi) with a line in none of the blocks found."""
    blocks = found.groupBy("d").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    covered = F.forall(F.sequence("lo", F.col("hi") - 1), lambda i: F.exists("blocks", lambda b: (b["lo"] <= i) & (i < b["hi"])))
    return wanted.join(blocks, "d", "left").where(F.col("blocks").isNull() | ~covered).select("d", "w", "lo", "hi")


def other_holders(open_: DataFrame, reps: DataFrame, shared: DataFrame, min_words: int) -> DataFrame:
    """(w, a): holders of open windows but the first, the first of those that look the same to all open documents."""
    last = stored(open_.groupBy("w").agg(F.max("d").alias("last")).join(shared, "w"), "open-windows")
    held = each_window(reps, min_words).join(last, "w").where((F.col("d") < F.col("last")) | (F.col("d") == F.col("first"))).select("w", F.col("d").alias("a"), "first").distinct()
    held = stored(held, "open-holders")
    seen = open_.select("d").distinct().join(reps, "d").select(F.explode("lines").alias("line")).distinct()
    seen = stored(seen, "open-lines")
    lines = held.select(F.col("a").alias("d")).distinct().join(reps, "d").select("d", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    known = lines.join(seen, "line").groupBy("d").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("x"))
    # a line and whether the one before it is known too; then whether the last is
    marked = F.transform("x", lambda x, k: F.struct(x["line"], x["i"] - F.when(k > 0, F.col("x")[k - 1]["i"]).otherwise(-1) == 1))
    looks = F.struct(*[F.xxhash64(F.lit(k), marked, F.element_at("x", -1)["i"] == F.col("n") - 1) for k in range(2)])
    look = known.select(F.col("d").alias("a"), looks.alias("look"))
    return held.join(look, "a").groupBy("w", "look").agg(F.min("a").alias("a"), F.first("first").alias("first")).where(F.col("a") != F.col("first")).select("w", "a")


def blocks_to_delete(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text) to doc_id, h and blocks: ranges of lines that an earlier document has; h is the text's hash."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.rtrim(x))
    arrays = docs.where("length(text) > 0").select(
        F.struct("doc_id", F.xxhash64("text").alias("h")).alias("d"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        F.transform(lines, lambda x: F.when(x == "", 0).otherwise(F.size(F.split(F.trim(x), r"\s+")))).alias("words"),
    )
    arrays = stored(arrays.withColumn("same", F.struct(F.xxhash64("lines").alias("a"), F.xxhash64(F.lit(1), "lines").alias("b"))), "line-hashes")
    copied = arrays.groupBy("same").agg(F.min("d").alias("one"), F.max("d").alias("last"), F.count("*").alias("n")).where("n > 1")
    copied = stored(copied, "equal-lines")  # so that the join has an exchange on both sides and Spark can split a hot key
    of = arrays.join(copied, "same", "left")
    reps = stored(of.where(F.col("one").isNull() | (F.col("d") == F.col("one"))).dropDuplicates(["d"]).select("d", "lines", "words"), "documents")
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.size("lines").alias("hi")))
    copies = of.where((F.col("d") != F.col("one")) & (F.aggregate("words", F.lit(0), lambda x, y: x + y) >= min_words)).select("d", whole.alias("blocks"))

    shared = each_window(reps, min_words).groupBy("w").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first != last")
    shared = stored(shared.select("w", "first"), "shared-windows")
    met = stored(each_window(reps, min_words).join(shared, "w").where(F.col("d") != F.col("first")), "windows")
    tried = stored(met.select("d", F.col("first").alias("a")).distinct(), "pairs")
    found = stored(align_pairs(tried, reps, min_words), "blocks")
    open_, size = stored(still_open(met, found), "open"), 1
    if not open_.isEmpty():
        left = stored(other_holders(open_, reps, shared, min_words), "holders")
        while not left.isEmpty():
            now = left.groupBy("w", F.pmod(F.xxhash64("a"), F.lit(size)).alias("k")).agg(F.min("a").alias("a")).select("w", "a")
            now = stored(now, "next-holders")
            pairs = open_.join(now, "w").where(F.col("a") < F.col("d")).select("d", "a").distinct()
            pairs = stored(pairs.join(tried, ["d", "a"], "left_anti"), "pairs")
            found = found.unionByName(stored(align_pairs(pairs, reps, min_words), "blocks"))
            tried = tried.unionByName(pairs)
            open_ = stored(still_open(open_, found), "open")
            left = left.join(now, ["w", "a"], "left_anti").join(open_.groupBy("w").agg(F.max("d").alias("last")), "w").where(F.col("a") < F.col("last")).select("w", "a")
            left, size = stored(left, "holders"), size * MORE
    every = found.unionByName(copies).select("d.doc_id", "d.h", "blocks")
    return every.groupBy("doc_id", "h").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))


def delete_blocks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with ``text`` less its deleted lines, and n_lines and n_removed; needs doc_id and text."""
    docs, restore = shielded(docs, "doc_id", "text")
    blocks = blocks_to_delete(docs.select("doc_id", "text"), min_words)
    keyed = docs.withColumn("h", F.xxhash64("text"))
    on = F.col("d.h").eqNullSafe(F.col("k.h")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    joined = keyed.alias("d").join(blocks.alias("k"), on, "left").select(*[f"d.{c}" for c in docs.columns], "k.blocks")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("blocks", lambda b: (b["lo"] <= i) & (i < b["hi"])))
    marked = joined.withColumn("n_lines", F.when(F.length("text") > 0, F.size(lines)).otherwise(0).cast("long"))
    marked = marked.withColumn("kept", F.when(F.col("blocks").isNotNull(), kept))
    marked = marked.withColumn("n_removed", F.when(F.col("kept").isNotNull(), F.col("n_lines") - F.size("kept")).otherwise(0).cast("long"))
    done = marked.withColumn("text", F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text")))
    return restore(done, "n_lines", "n_removed")


def op10_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = delete_blocks(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))

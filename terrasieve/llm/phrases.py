"""Removal of repeated passages by prefix-free parsing, for text that repeats much.

A rolling hash sets triggers: positions whose hash is the least of a stretch of
starts. A passage of ``length`` bytes belongs to the first least position among its
first starts, so equal passages have equal triggers at equal distance, and what is
before the trigger and what follows it can be ordered apart:

* The dictionary holds every phrase that ends at a trigger once, in the order of its
  bytes read back from there. Phrases that share a suffix stand together, and the
  lengths that neighbours share say which suffixes are classes of their own: this is
  the suffix array of the dictionary, all suffix lengths with the same phrases at a time.
* The parse says what follows each occurrence of a phrase; its suffixes are sorted to
  the depth of a passage.
* Combined, a class of the dictionary with its suffixes of the parse in order is a
  stretch of the corpus order. A passage occurs again if and only if it is as long as
  what its place shares with one of its two neighbours there.

Occurrences whose first bytes after the trigger occur once can't repeat, and those that
agree in all their context repeat as a whole; both are settled by counting digests
(128 bits) and are not ordered. Everything that is ordered is compared by bytes. Sorts
are by range over keys that no two rows share, so no class or phrase has to fit in a task;
what neighbouring ranges have in common is passed on as one or two rows a range.

Defined results: a null text is empty; texts shorter than ``length`` keep all bytes;
passages never cross documents but may repeat in one; very long texts are cut in slices
of ``SLICE`` starts while they are parsed, without effect on the result; rows with the same
doc_id and text count as two occurrences; ties (equal passages) all go; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, stored, table, texts_of

#: Bytes under the rolling hash, and starts in the stretch of which a trigger is the least.
GRAM = 8
STRETCH = 300
#: Rows in a range of a sort.
RANGE_ROWS = 250_000
#: Starts handled at once; positions in a slice take 24 bits.
SLICE = 1 << 23


def triggers(x: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trigger of each run of passages, and the first start and the end of the run."""
    starts = len(x) - length + 1
    grams = np.ndarray((starts + STRETCH - 1,), "<u8", x, 0, (1,))
    h = grams * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64((1 << 24) - 1)
    h = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the first
    rows = np.concatenate([h, np.full(-len(h) % STRETCH, ~np.uint64(0))]).reshape(-1, STRETCH)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(rows, axis=1).reshape(-1)
    at = (np.minimum(ahead[:starts], behind[STRETCH - 1 :][:starts]) & low).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[lo], lo, np.append(lo[1:], starts)


def parse(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, t, text) to a row for each phrase: what it begins with (core), its entry (ctx), place and size."""
    from xxhash import xxh3_64_intdigest as digest

    kept = length - STRETCH  # bytes from a trigger on that all its passages share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core, ctx, start, size, lead, times = [], [], [], [], [], []
            for x in texts_of(batch):
                before = len(core)
                for base in range(0, len(x or b"") - length + 1, SLICE):
                    y = x[base : base + SLICE + length - 1] if len(x) > SLICE else x
                    for m, lo, hi in zip(*[v.tolist() for v in triggers(y, length)]):
                        core.append(digest(y[m : m + kept]))
                        ctx.append(digest(y[lo : hi + length - 1]))
                        start.append(base + lo)
                        size.append(hi - lo)
                        lead.append(m - lo)
                times.append(len(core) - before)
            row = np.repeat(np.arange(batch.num_rows), times)
            longs = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (core, ctx)]
            place = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "t")]
            yield pa.RecordBatch.from_arrays([*longs, *place, pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(lead, pa.int32())], ["core", "ctx", "doc_id", "t", "start", "size", "lead"])

    return docs.mapInArrow(run, "core long, ctx long, doc_id long, t long, start long, size int, lead int")


def read_entries(entries: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Each distinct entry with its bytes, read at one of its places: ``left`` before the trigger, turned round, ``right`` from it on; passages begin ``low`` bytes before it or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core, ctx, low, left, right = [], [], [], [], []
            for x, found in zip(texts_of(batch), batch.column("entries")):
                for e in found.as_py():
                    m, after = e["start"] + e["lead"], length - e["lead"] + e["size"] - 1
                    core.append(e["core"])
                    ctx.append(e["ctx"])
                    low.append(e["lead"] - e["size"] + 1)
                    left.append(x[e["start"] : m][::-1])
                    right.append(x[m : m + after])
                    if len(core) == 1 << 14:
                        yield rows(core, ctx, low, left, right)
                        core, ctx, low, left, right = [], [], [], [], []
            yield rows(core, ctx, low, left, right)

    def rows(core: list, ctx: list, low: list, left: list, right: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((core, ctx, low, left, right), kinds)], ["core", "ctx", "low", "left", "right"])

    per_text = entries.groupBy("place.doc_id", "place.t").agg(F.collect_list(F.struct("core", "ctx", "place.start", "place.size", "place.lead")).alias("entries"))
    on = F.col("d.t").eqNullSafe(F.col("p.t")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
    places = docs.alias("d").join(per_text.alias("p"), on).select("d.text", "p.entries")
    return places.mapInArrow(run, "core long, ctx long, low int, left binary, right binary")


def common(x: pa.Array) -> np.ndarray:
    """How many bytes each row begins with as the row before does; the first row's count is 0."""
    raw, ends = np.frombuffer(x.buffers()[2] or b"", np.uint8), np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    sizes = np.diff(ends)
    both = np.minimum(sizes[1:], sizes[:-1])
    out, live, at = np.zeros(len(x), np.int32), np.arange(1, len(x)), 0
    width = 16
    while len(live):  # a stretch of bytes at a time, of the rows that agree so far
        step = np.arange(at, at + width)
        a, b = (np.minimum(ends[live - k][:, None] + step, max(0, len(raw) - 1)) for k in (0, 1))
        differ = (raw[a] != raw[b]) | (step >= both[live - 1][:, None])
        found = differ.any(1)
        out[live[found]] = at + differ[found].argmax(1)
        live, at, width = live[~found], at + width, 64
    return out


def depths(shared: list[int]) -> list[list[int]]:
    """Of each row the lengths it shares with any row before it in order, given those shared with the row just before (-1: another group)."""
    out, stack = [], []
    for c in shared:
        while stack and stack[-1] > c:
            stack.pop()
        if c >= 0 and (not stack or stack[-1] < c):
            stack.append(c)
        out.append(stack[:])
    return out


def ordered(n: int, df: DataFrame, *keys: str) -> DataFrame:
    return df.repartitionByRange(max(n, 1), *keys).sortWithinPartitions(*keys)


def ranges_for(df: DataFrame) -> int:
    """Ranges of a sort: one for each core, more where a range would have over ``RANGE_ROWS`` rows. Few, as the driver is sent some hundred keys of each to find their bounds."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // RANGE_ROWS))


def dictionary_order(phrases: DataFrame) -> DataFrame:
    """(core, left, n) with all different, to these and ``shared``: the lengths of the suffixes that a phrase has in common with any other of its core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if not (held := [b for b in batches if b.num_rows]):
            return
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        core, lens = t.column("core").to_numpy(), np.diff(np.frombuffer(t.column("left").buffers()[1], np.int32)[t.column("left").offset :][: len(t) + 1])
        lcp = common(t.column("left"))
        lcp[1:][core[1:] != core[:-1]] = -1
        lcp[0] = -1
        back = np.append(lcp[1:], -1)
        with_last = np.minimum.accumulate(np.append(back[:-1], lens[-1])[::-1])[::-1]
        with_first = np.minimum.accumulate(np.concatenate([lens[:1], lcp[1:]]))
        before, after = depths(lcp.tolist()), depths(back[::-1].tolist())[::-1]
        shared = pa.array([sorted({*a, *b}) for a, b in zip(before, after)], pa.list_(pa.int32()))
        pid = pa.array(np.full(len(t), TaskContext.get().partitionId(), np.int32))
        yield pa.RecordBatch.from_arrays([*t.columns, shared, pid, pa.array(with_first.astype(np.int32)), pa.array(with_last.astype(np.int32))], ["core", "left", "n", "shared", "pid", "with_first", "with_last"])

    sorted_ = ordered(ranges_for(phrases), phrases.select("core", "left", "n"), "core", "left")
    done = stored(sorted_.mapInArrow(run, "core long, left binary, n long, shared array<int>, pid int, with_first int, with_last int"), "dictionary")
    end = F.struct("core", "left")
    seen = lambda c: F.collect_set(F.when(F.col(c) >= 0, F.col(c)))
    ends = done.groupBy("pid").agg(F.min(end).alias("first"), F.max(end).alias("last"), seen("with_first").alias("of_first"), seen("with_last").alias("of_last"))
    across = across_ranges(sorted((r.asDict(recursive=True) for r in ends.collect()), key=lambda r: r["pid"]))  # a row a range
    more = done.sparkSession.createDataFrame(across, "pid int, before array<int>, after array<int>")
    every = F.concat("shared", F.filter("before", lambda v: v <= F.col("with_first")), F.filter("after", lambda v: v <= F.col("with_last")))
    return done.join(F.broadcast(more), "pid").select("core", "left", "n", F.array_sort(F.array_distinct(every)).alias("shared"))


def across_ranges(ends: list[dict]) -> list[tuple[int, list[int], list[int]]]:
    """(pid, before, after): lengths that the first (last) phrase of a range shares with phrases of the ranges before (after) it."""

    def same(a: dict, b: dict) -> int:
        if a["core"] != b["core"]:
            return -1
        x, y = bytes(a["left"]), bytes(b["left"])
        return next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))

    def carried(rows: list[dict], near: str, far: str, of_far: str) -> list[list[int]]:
        out: list[set[int]] = [set()]
        for a, b in zip(rows, rows[1:]):
            c, through = same(a[far], b[near]), same(a[near], a[far])
            out.append({min(c, v) for v in a[of_far]} | {min(c, through, v) for v in (out[-1] if through >= 0 else ())} if c >= 0 else set())
        return [sorted(x) for x in out]

    before = carried(ends, "first", "last", "of_last")
    after = carried(ends[::-1], "last", "first", "of_first")[::-1]
    return [(e["pid"], a, b) for e, a, b in zip(ends, before, after)]


def corpus_order(entries: DataFrame, dictionary: DataFrame, length: int) -> DataFrame:
    """Entries with their phrases' shared suffixes, to (core, ctx, lo, hi): passages that begin lo to hi bytes before the trigger occur again."""
    shared = F.when(F.col("n") > 1, F.concat("shared", F.array(F.length("left")))).otherwise(F.col("shared"))  # others have this very phrase
    classes = F.transform("ys", lambda y, i: F.struct(F.greatest(F.when(i > 0, F.get("ys", i - 1) + 1).otherwise(0), F.col("low")).alias("lo"), y.alias("hi")))
    each = entries.join(dictionary, ["core", "left"]).withColumn("ys", F.array_distinct(shared)).select("core", "ctx", "left", "right", F.inline(F.filter(classes, lambda s: s["lo"] <= s["hi"])))
    suffix = [F.xxhash64(F.lit(k), "core", "hi", F.expr("substring(left, 1, hi)")).alias(f"c{k}") for k in range(2)]
    rows = stored(each.select(*suffix, F.expr(f"substring(right, 1, {length} - lo)").alias("right"), "core", "ctx", "lo", "hi"), "suffixes")
    names = ["c0", "c1", "right", "core", "ctx", "lo", "hi"]

    def found(t: pa.RecordBatch, best: np.ndarray) -> list[pa.Array]:
        """Places of the order with ``best`` bytes in common with a neighbour: what of them occurs again."""
        lo = np.maximum(t.column("lo").to_numpy(), length - best)
        hit = np.flatnonzero(lo <= t.column("hi").to_numpy())
        return [*[t.column(c).take(pa.array(hit)) for c in ("core", "ctx")], pa.array(lo[hit].astype(np.int32)), t.column("hi").take(pa.array(hit))]

    def shares(t: pa.RecordBatch) -> np.ndarray:
        lcp = common(t.column("right"))
        a, b = t.column("c0").to_numpy(), t.column("c1").to_numpy()
        lcp[1:][(a[1:] != a[:-1]) | (b[1:] != b[:-1])] = 0
        return lcp

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, held, first = TaskContext.get().partitionId(), None, True

        def out(t: pa.RecordBatch, best: np.ndarray) -> pa.RecordBatch:
            cols = found(t, best)
            return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(cols[0]), EDGE)], ["core", "ctx", "lo", "hi", "edge"])

        def edge(t: pa.RecordBatch, side: int) -> pa.RecordBatch:
            row = {"pid": pid, "side": side, **{c: t.column(c)[0].as_py() for c in names}}
            return pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32())], pa.array([row], EDGE)], ["core", "ctx", "lo", "hi", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                yield edge(batch.slice(0, 1), 0)
                first = False
            t = batch if held is None else pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            lcp = shares(t)
            best = np.maximum(lcp, np.append(lcp[1:], 0))
            # the last two rows come again: the last has no row after it yet, the one before says what that shares with it
            lo = 0 if held is None else len(held) - 1
            if len(t) - 1 > lo:
                yield out(t.slice(lo, len(t) - 1 - lo), best[lo:-1])
            held = [t.slice(max(0, len(t) - 2), 1), t.slice(len(t) - 1, 1)] if len(t) > 1 else [t]
        if held is not None:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield out(t.slice(len(t) - 1, 1), shares(t)[-1:])
            yield edge(held[-1], 1)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lcp = shares(t)
            yield pa.RecordBatch.from_arrays(found(t, np.maximum(lcp, np.append(lcp[1:], 0))), ["core", "ctx", "lo", "hi"])

    EDGE = pa.struct([("pid", pa.int32()), ("side", pa.int32()), ("c0", pa.int64()), ("c1", pa.int64()), ("right", pa.binary()), ("core", pa.int64()), ("ctx", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
    dealt = ordered(ranges_for(rows), rows, "c0", "c1", "right", "core", "ctx")
    schema = "core long, ctx long, lo int, hi int, edge struct<pid:int,side:int,c0:long,c1:long,right:binary,core:long,ctx:long,lo:int,hi:int>"
    inside = stored(dealt.mapInArrow(run, schema), "order")
    # the first and the last row of each range, in order; a range of one row gives it twice, which must not meet itself
    ends = inside.where("edge is not null").select("edge.*").groupBy(*names).agg(F.min("pid").alias("pid"), F.min("side").alias("side"))
    seams = ends.coalesce(1).sortWithinPartitions("pid", "side").select(*names).mapInArrow(between, "core long, ctx long, lo int, hi int")
    return inside.where("edge is null").select("core", "ctx", "lo", "hi").union(seams)


def repeated(phrases: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Of each occurrence (doc_id, t, start) the ranges of its starts (lo, hi) that begin a passage which occurs again."""
    groups = phrases.groupBy("core").agg(F.count("*").alias("total"), F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("total > 1")
    # written first, so that the join has an exchange on both sides and Spark can split a hot key
    groups = stored(groups.select("core", (F.col("a") != F.col("b")).alias("mixed")), "cores")
    found = stored(phrases.join(groups, "core"), "phrases")
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("size").alias("hi")))
    settled = found.where("not mixed").select("doc_id", "t", "start", whole.alias("ranges"))
    mixed = found.where("mixed")
    distinct = stored(mixed.groupBy("core", "ctx").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "t", "start", "size", "lead")).alias("place")), "distinct")
    entries = stored(read_entries(distinct, docs, length), "entries")
    words = stored(entries.groupBy("core", "left").agg(F.count("*").alias("n")), "words")
    again = corpus_order(entries, stored(dictionary_order(words), "dictionary-order"), length)
    # back to offsets in the entry; one that occurs twice repeats as a whole
    parts = again.groupBy("core", "ctx").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    starts = F.transform("r", lambda r: F.struct((F.col("place.lead") - r["hi"]).alias("lo"), (F.col("place.lead") - r["lo"] + 1).alias("hi")))
    all_of = F.array(F.struct(F.lit(0).alias("lo"), F.col("place.size").alias("hi")))
    of_entry = distinct.join(parts, ["core", "ctx"], "left").select("core", "ctx", F.when(F.col("times") > 1, all_of).otherwise(starts).alias("ranges")).where("ranges is not null")
    joined = mixed.join(stored(of_entry, "entry-ranges"), ["core", "ctx"])
    return settled.union(joined.select("doc_id", "t", "start", "ranges"))


def merged_spans(spans: pa.Array) -> list[np.ndarray]:
    """Of each row its spans (lo, hi), those that touch made one, in order."""
    n = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(spans)
    lo, hi = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
    row, reach = np.repeat(np.arange(len(n)), n), int(hi.max(initial=0)) + 2
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    far = np.maximum.accumulate(hi + row * reach) if len(hi) else hi
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(lo)), bool), lo[1:] + row[1:] * reach > far[:-1]]))
    out = np.stack([lo[begin], far[np.append(begin[1:], len(lo)) - 1] - row[begin] * reach], 1) if len(begin) else np.zeros((0, 2), np.int64)
    return np.split(out, np.searchsorted(row[begin], np.arange(1, len(n)))) if len(n) else []


def remove_repeats(docs: DataFrame, *, length: int = 400, text: bool = True) -> DataFrame:
    """(doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``text``, kept (the bytes) and spans."""
    if length <= STRETCH + GRAM:
        raise ValueError(f"length must be over {STRETCH + GRAM}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("t"), "text")
    long = docs.where(F.octet_length("text") >= length)
    starts = repeated(stored(parse(long, length), "parse"), long, length)
    spans = F.transform("ranges", lambda r: F.struct((F.col("start") + r["lo"]).alias("lo"), (F.col("start") + r["hi"] + length - 1).alias("hi")))
    per_text = stored(starts.select("doc_id", "t", F.explode(spans).alias("s")).groupBy("doc_id", "t").agg(F.collect_list("s").alias("spans")), "spans")
    on = F.col("d.t").eqNullSafe(F.col("p.t")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
    joined = docs.alias("d").join(per_text.alias("p"), on, "left").select("d.doc_id", "d.text", "p.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, merged in zip(texts_of(batch), merged_spans(batch.column("spans"))):
                x = x or b""
                ends = [0, *merged.reshape(-1).tolist(), len(x)]
                kept = b"".join([x[a:b] for a, b in zip(ends[::2], ends[1::2])])
                rows.append((len(x), len(x) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept, [{"lo": a, "hi": b} for a, b in merged.tolist()] if text else None)[: 6 if text else 4])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))]
            cols = list(zip(*rows)) or [()] * (6 if text else 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, k) for v, k in zip(cols, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: 7 if text else 5])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(run, schema + (", kept binary, spans array<struct<lo:long,hi:long>>" if text else ""))


def op9_phrase_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), text=False)

"""A gated recurrent language model, trained and applied in Spark tasks with numpy.

Words are counted over all training rows. The most frequent ones have embeddings
and sit in classes by frequency; the rest share classes by their first two bytes,
inside which a word has its smoothed share of the count. The output is factored:
first the class from the state, then the word inside its class. Training is
truncated backpropagation in every task over its part of a round's rows, after
which parameters are averaged by the tokens seen. Scoring carries the state through
a whole document, however long, so the result is the log-likelihood of all of it.

The rounds visit every training row once, dealt to them by a hash of the id, so the
work grows with the input; the counts are over all of them. Words beyond the
broadcast vocabulary are joined to their counts, so nothing that is broadcast grows
with the data.

Defined results: a null text is an empty one, of which the end alone is scored; an
unseen word counts as the one unseen word of its class; without training rows the
model is uniform; a very long document is read in pieces or windows, each from where the one
before ended; rows with equal ids and texts are scored each; words of equal count are taken
in order of their bytes; an empty documents table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, crc_mod, pick, stored, table

END = b""
#: Words with embeddings, in classes of so many.
FREQUENT, CLASS = 1024, 32
#: Classes of the other words.
RARE = 32
#: Words whose counts are broadcast: some 10 MB.
BROADCAST_WORDS = 200_000
HIDDEN, EMBEDDING = 16, 12
#: Steps of truncated backpropagation, documents side by side.
STEPS, SIDE = 16, 512
#: Windows of text that a lane takes at least when it has none left, the longest window, and rows of logits made at once.
TAKEN, LONGEST, ROWS = 8, 512, 1024
#: Bytes of text split at once.
SPLIT = 1 << 24
#: Tokens in a piece of a long document, and in the long documents that wait for each other at most.
PIECE, WAITING = 512, 1 << 22
#: Training rows are dealt in PARTS by hash; round r takes part r, so with as many rounds each row is visited once.
ROUNDS = PARTS = 3
RATE = 0.01
#: Parameters to a row while they are averaged, and tasks averaged before all are.
SLICE, FAN = 1 << 12, 64


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def rare_class(word: bytes) -> int:
    return crc32(word[:2]) % RARE


def split_words(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The words of the batch's texts, one after another, and how many each text has, some ``SPLIT`` bytes of texts at a time: ``words_of`` by columns."""
    texts = batch.column("text").cast(pa.large_string())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SPLIT)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo)))
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.list_flatten(lists).cast(pa.large_binary())
        some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves an empty one
        if not some.all():
            n = np.bincount(np.repeat(np.arange(len(n)), n)[some], minlength=len(n))
            words = words.filter(pa.array(some))
        yield words, n


def count_words(train: DataFrame) -> DataFrame:
    """(text) to word and c, each text's end counted as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n in split_words(batch):
                coded = words.dictionary_encode()
                c = np.append(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)), len(n))
                each = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_arrays([each, pa.array(c, pa.int64())], ["word", "c"])

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the most frequent words, and what all words add up to."""

    index: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int
    rare_mass: np.ndarray  # of each rare class: its counts, one more for each word, and one for the unseen

    @classmethod
    def of(cls, counts: DataFrame, frequent: int = FREQUENT, most: int = BROADCAST_WORDS) -> Vocabulary:
        """The driver gets at most ``most`` words and the end, one row for each sixteenth of a power of two of c, and one for each rare class.

        Words are taken down to the last such step of the count that fits, so no task has to order them all.
        """
        step = F.floor(16 * F.log2("c")).cast("int")
        sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
        least, held = 1 << 30, 0
        for r in sorted(sizes, key=lambda r: -r["step"]):
            if held + r["n"] > most:
                break
            least, held = r["step"], held + r["n"]
        top = counts.where((step >= least) | (F.col("word") == F.lit(END))).toArrow()
        ranked = sorted(zip((-x for x in top.column("c").to_pylist()), top.column("word").to_pylist()))
        words, c = [w for _, w in ranked], np.array([-n for n, _ in ranked], np.int64)
        sums = counts.groupBy((F.crc32(F.substring("word", 1, 2)) % RARE).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
        mass = np.ones(RARE)
        for r in sums:
            mass[r["k"]] += r["c"] + r["n"]
        if END in words and words.index(END) >= frequent:  # the end always has an embedding
            i = words.index(END)
            words.insert(frequent - 1, words.pop(i))
            c = np.insert(np.delete(c, i), frequent - 1, c[i])
        for w, n in zip(words[:frequent], c[:frequent].tolist()):
            mass[rare_class(w)] -= n + 1
        return cls({w: i for i, w in enumerate(words)}, c, sum(r["c"] for r in sums), sum(r["n"] for r in sums), np.maximum(mass, 1.0))

    def model_ids(self, frequent: int) -> np.ndarray:
        """Of each broadcast word, its embedding: its own, or that of its rare class."""
        return np.array([i if i < frequent else frequent + rare_class(w) for w, i in self.index.items()], np.int32)


def augmented(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights with the biases as one more row, and of each such matrix whether its logits have to be shifted: a state is within -1 and 1."""
    reach = np.abs(w).sum(-2)
    wide = ((b + reach).max(-1) > 60) | ((b - reach).min(-1) < -60)
    return np.concatenate([w, b[..., None, :]], -2), wide


def softmax(h: np.ndarray, w: np.ndarray, wide: bool, at: np.ndarray, grad: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln of the share of column ``at`` of each row of h @ w; with ``grad``, to which that of the weights is added, also the gradient for h."""
    a, rows = h @ w, np.arange(len(at))
    if wide:
        a -= a.max(1, keepdims=True)
    ln = a[rows, at]
    np.exp(a, out=a)
    s = a @ np.ones(a.shape[1], a.dtype)
    ln -= np.log(s)
    if grad is None:
        return ln, None
    a[rows, at] -= s  # all of this row is still to be divided by s
    s = (1 / s)[:, None]
    grad += (a.T @ (h * s)).T
    dh = a @ w[:-1].T
    dh *= s
    return ln, dh


class GRU:
    """Parameters, forward and backward passes. Inputs: frequent words, then rare classes."""

    def __init__(self, frequent: int = FREQUENT, hidden: int = HIDDEN, seed: int = 7):
        self.frequent, self.hidden = frequent, hidden
        self.classes = -(-frequent // CLASS) + RARE
        r = np.random.default_rng(seed)
        shape = {"emb": (frequent + RARE, EMBEDDING), "wx": (EMBEDDING, 3 * hidden), "u": (hidden, 3 * hidden), "b": (3 * hidden,), "wc": (hidden, self.classes), "bc": (self.classes,), "ww": (self.classes - RARE, hidden, CLASS), "bw": (self.classes - RARE, CLASS)}
        self.p = {k: (r.standard_normal(s) * (0.0 if k in ("b", "bc", "bw", "wc", "ww") else 0.3 if k == "emb" else s[0] ** -0.5)).astype(np.float32) for k, s in shape.items()}

    def start_at_counts(self, v: Vocabulary) -> None:
        """Output biases that give each class and word its share of the counts."""
        c = np.zeros((self.classes - RARE) * CLASS)
        n = min(self.frequent, len(v.counts))
        c[:n] = v.counts[:n] + 1
        c = c.reshape(-1, CLASS)
        self.p["bw"][:] = np.where(c > 0, np.log(np.maximum(c, 1) / np.maximum(c.max(1, keepdims=True), 1)), -30)
        self.p["bc"][:] = np.log(np.concatenate([c.sum(1) + 1e-9, v.rare_mass]) + 1e-9)
        self.p["bc"] -= self.p["bc"].max()

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.p.values()])

    def load(self, flat: np.ndarray) -> GRU:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def inputs(self) -> np.ndarray:
        """What each word gives to the gates."""
        return self.p["emb"] @ self.p["wx"] + self.p["b"]

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        n = self.hidden
        hu = h @ self.p["u"]
        zr = hu[:, : 2 * n] + x[:, : 2 * n]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, hu = zr[:, :n], zr[:, n:], hu[:, 2 * n :]
        new = r * hu
        new += x[:, 2 * n :]
        np.tanh(new, out=new)
        out = h - new
        out *= z
        out += new
        return out, (h, hu, z, r, new)

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.frequent, ids // CLASS, ids - self.frequent + self.classes - RARE)

    def output(self, h: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln of the class and, for frequent words, of the word in it; with ``grads`` also the gradient of the summed loss for h."""
        p, cls, n = self.p, self.class_of(ids), self.hidden
        wc, wide = augmented(p["wc"], p["bc"])
        h1 = np.ones((len(ids), n + 1), h.dtype)
        h1[:, :n] = h
        out = np.empty(len(ids))
        gc, dh = (np.zeros_like(wc), np.empty((len(ids), n), h.dtype)) if grads is not None else (None, None)
        for i in range(0, len(ids), ROWS):  # some rows at a time, so that their logits stay in the cache
            some = slice(i, i + ROWS)
            out[some], d = softmax(h1[some], wc, wide, cls[some], gc)
            if grads is not None:
                dh[some] = d
        own = np.flatnonzero(ids < self.frequent)
        own = own[np.argsort(cls[own].astype(np.uint16), kind="stable")]
        ends = np.searchsorted(cls[own], np.arange(self.classes - RARE + 1))
        ww, wide = augmented(p["ww"], p["bw"])
        gw = np.zeros_like(ww) if grads is not None else None
        sorted_h, column, inside, back = h1[own], ids[own] % CLASS, np.empty(len(own)), np.empty((len(own), n), h.dtype)
        for k in np.flatnonzero(np.diff(ends)).tolist():
            for i in range(int(ends[k]), int(ends[k + 1]), 2 * ROWS):
                some = slice(i, min(i + 2 * ROWS, int(ends[k + 1])))
                inside[some], d = softmax(sorted_h[some], ww[k], wide[k], column[some], gw[k] if grads is not None else None)
                if grads is not None:
                    back[some] = d
        out[own] += inside
        if grads is not None:
            dh[own] += back
            for name, bias, g in (("wc", "bc", gc), ("ww", "bw", gw)):
                grads[name] += g[..., :-1, :]
                grads[bias] += g[..., -1, :]
        return out, dh

    def backward(self, inputs: np.ndarray, caches: list, dhs: np.ndarray, grads: dict, keep: np.ndarray | None = None) -> None:
        """Through the steps of one window; what came before it is taken as given. ``keep`` is 0 where a state was cleared before its step."""
        p, n = self.p, self.hidden
        dh, (steps, lanes) = np.zeros_like(dhs[0]), dhs.shape[:2]
        dx, y = np.empty((steps, lanes, 3 * n), dhs.dtype), np.empty((lanes, 3 * n), dhs.dtype)
        ut = np.ascontiguousarray(p["u"].T)
        for t in range(steps - 1, -1, -1):
            h, hu, z, r, new = caches[t]
            dh += dhs[t]
            gz = dh * z
            dnew = dh - gz
            dnew *= 1 - new * new
            x = dx[t]
            x[:, 2 * n :] = dnew
            dnew *= r
            y[:, 2 * n :] = dnew
            dnew *= hu
            np.multiply(dnew, 1 - r, out=x[:, n : 2 * n])
            np.multiply(gz * (1 - z), h - new, out=x[:, :n])
            y[:, : 2 * n] = x[:, : 2 * n]
            grads["u"] += h.T @ y
            dh = y @ ut
            dh += gz
            if keep is not None:
                dh *= keep[t]
        flat, ids = dx.reshape(-1, 3 * n), inputs.reshape(-1)
        grads["b"] += np.ones(len(flat), flat.dtype) @ flat
        order = np.argsort(ids.astype(np.uint16) if len(p["emb"]) < 1 << 16 else ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        if len(first):  # of each word once, however often it stands
            words, sums = ids[order][first], np.add.reduceat(np.take(flat, order, axis=0), first, axis=0)
            grads["wx"] += p["emb"][words].T @ sums
            grads["emb"][words] += sums @ p["wx"].T


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.n = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def update(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        cut = min(1.0, 1.0 / (norm + 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, x in p.items():
            d, m, v = g[k] * np.float32(cut), self.m[k], self.v[k]
            m += np.float32(0.1) * (d - m)
            d *= d
            v += np.float32(0.001) * (d - v)
            x -= np.float32(rate) * m / (np.sqrt(v) + np.float32(1e-8))


def pieces_of(model: GRU, docs: list[np.ndarray], end: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Long documents in pieces, each with the state and the token before it: one forward pass over all of them side by side."""
    docs = sorted(docs, key=len, reverse=True)
    long, xw, h, out = np.array([len(d) for d in docs]), model.inputs(), np.zeros((len(docs), model.hidden), np.float32), []
    for a in range(0, int(long[0]), PIECE):
        n = int(np.searchsorted(-long, -a, side="left"))  # documents longer than that
        docs, h, some = docs[:n], h[:n], [d[a : a + PIECE] for d in docs[:n]]
        out += [(x, h[i].copy(), int(docs[i][a - 1]) if a else end) for i, x in enumerate(some)]
        full = [i for i, x in enumerate(some) if len(x) == PIECE]  # the first ones; the others end here
        if not full:
            break
        before = np.array([np.concatenate([[docs[i][a - 1] if a else end], some[i][:-1]]) for i in full]).T
        h = h[: len(full)]
        for x in np.take(xw, before, axis=0):
            h, _ = model.step(x, h)
    return out


def train_on(model: GRU, docs: Iterator[np.ndarray], end: int, rate: float = RATE, steps: int = STEPS, side: int = SIDE) -> int:
    """Truncated backpropagation over documents in ``side`` lanes; returns the tokens seen.

    A lane takes the next document where its last one ends, and goes on from window to window with
    its state and last token, so what is cut goes on from where it was. Documents of over two pieces
    wait for each other and are then read in pieces side by side, each from the state that a forward
    pass over all before it leaves. Where few lanes are left windows are longer, and parameters move
    when about as many tokens as a full window has are seen.
    """
    adam, seen, due, more = Adam(model.p, rate), 0, 0, iter(docs)
    held = [np.zeros(0, np.int32)] * side  # of each lane what it still has to read
    h, last = np.zeros((side, model.hidden), np.float32), np.full(side, end, np.int32)
    pieces: list[tuple[np.ndarray, np.ndarray, int]] = []
    waiting: list[np.ndarray] = []
    width = steps
    grads, inputs = {k: np.zeros_like(x) for k, x in model.p.items()}, model.inputs()

    def following() -> np.ndarray | None:
        """The next document that isn't long."""
        nonlocal waiting, pieces
        for d in more:
            if len(d) <= 2 * PIECE:
                return d
            waiting.append(d)
            if sum(map(len, waiting)) > WAITING:
                break
        if waiting:
            pieces, waiting = pieces + pieces_of(model, waiting, end), []
        return None

    while True:
        for lane, x in enumerate(held):
            if not len(x) and pieces:
                held[lane], h[lane], last[lane] = pieces.pop()
            elif (size := len(x)) < width and (not size or x[-1] == end):
                taken = [x]
                while size < width * TAKEN and (d := following()) is not None:
                    taken.append(d)
                    size += len(d)
                held[lane] = np.concatenate(taken)
        lanes = np.array([i for i, x in enumerate(held) if len(x)], np.int64)
        if not len(lanes) and pieces:
            continue
        if due >= side * steps // 2 or not len(lanes) and due:
            adam.update(model.p, {k: g / np.float32(due) for k, g in grads.items()})
            grads, due, inputs = {k: np.zeros_like(x) for k, x in model.p.items()}, 0, model.inputs()
        if not len(lanes):
            return seen
        width = max(steps, min(LONGEST, side * steps // len(lanes)))
        sizes = np.array([min(width, len(held[i])) for i in lanes.tolist()])
        target = np.full((int(sizes.max()), len(lanes)), end, np.int32)  # time by lane
        for j, (lane, n) in enumerate(zip(lanes.tolist(), sizes.tolist())):
            target[:n, j] = held[lane][:n]
            held[lane] = held[lane][n:]
        live = np.arange(len(target))[:, None] < sizes
        before = np.concatenate([last[lanes][None, :], target[:-1]])
        x = np.take(inputs, before, axis=0)
        keep = (before != end)[:, :, None].astype(np.float32)  # a document starts from nothing
        state, caches, hs = h[lanes], [], np.empty((*before.shape, model.hidden), np.float32)
        for t in range(len(target)):
            state, cache = model.step(x[t], state * keep[t])
            caches.append(cache)
            hs[t] = state
        _, dh = model.output(hs[live], target[live], grads)
        back = np.zeros_like(hs)
        back[live] = dh
        model.backward(before, caches, back, grads, keep)
        at = (sizes - 1, np.arange(len(lanes)))
        h[lanes], last[lanes] = hs[at], target[at]
        seen, due = seen + int(sizes.sum()), due + int(sizes.sum())


@dataclass
class Encoded:
    """Texts one after another, each with its end: places in the broadcast vocabulary (-1: none), model ids, where each text begins; and the words without a place, each once a text."""

    at: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    unknown: pa.ListArray

    def documents(self) -> list[np.ndarray]:
        return np.split(self.ids, self.first[1:]) if len(self.first) else []


class Encoder:
    def __init__(self, v: Vocabulary, to_model: np.ndarray, frequent: int):
        self.words, self.to_model, self.frequent, self.end = pa.array(list(v.index), pa.large_binary()), to_model, frequent, v.index.get(END, -1)

    def __call__(self, words: pa.Array, n: np.ndarray) -> Encoded:
        """Words of texts one after another, n of each."""
        found = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False)
        first = np.cumsum(n + 1) - (n + 1)
        at = np.full(len(found) + len(n), self.end, np.int32)
        is_word = np.ones(len(at), bool)
        is_word[first + n] = False
        at[is_word] = found
        ids = self.to_model[at] if len(self.to_model) else np.zeros(len(at), np.int32)
        if self.end < 0:
            ids[~is_word] = self.frequent + rare_class(END)
        rest = np.flatnonzero(found < 0)
        coded = words.take(pa.array(rest)).dictionary_encode()
        each, code = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
        ids[np.flatnonzero(is_word)[rest]] = np.array([self.frequent + rare_class(w) for w in each.to_pylist()], np.int32)[code]
        row = np.repeat(np.arange(len(n)), n)[rest]
        key, times = np.unique(row * max(len(each), 1) + code, return_counts=True)
        row, code = np.divmod(key, max(len(each), 1))
        pairs = pa.StructArray.from_arrays([each.take(pa.array(code)), pa.array(times, pa.int64())], ["word", "n"])
        return Encoded(at, ids, first, pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32()), pairs))


def averaged(rows: DataFrame, part: str, order: str) -> DataFrame:
    """Means of the slices of each part, weighted by n, summed in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, weight = None, np.zeros(0), 0

        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([weight], pa.int64()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["slice", "part", "n", "p"])

        for batch in batches:
            for *key, n, x in zip(*[batch.column(c).to_pylist() for c in ("slice", "part", "n")], batch.column("p")):
                y = np.frombuffer(x.as_py(), np.float32).astype(np.float64)
                if key != at:
                    if at is not None:
                        yield one()
                    at, total, weight = key, np.zeros(len(y)), 0
                total, weight = total + y * n, weight + n
        if at is not None:
            yield one()

    dealt = rows.select("slice", "part", order, "n", "p").repartition("slice", "part").sortWithinPartitions("slice", "part", order)
    return dealt.select("slice", "part", "n", "p").mapInArrow(run, "slice int, part int, n long, p binary")


def train(rows: DataFrame, v: Vocabulary, *, frequent: int = FREQUENT, rounds: int = ROUNDS, parts: int = PARTS) -> GRU:
    """Rounds of training in all tasks at once over (doc_id, text), each ending in the mean of their parameters."""
    model, spark = GRU(frequent), rows.sparkSession
    model.start_at_counts(v)
    shared, to_model = spark.sparkContext.broadcast(v), v.model_ids(frequent)
    for r in range(rounds):
        current = spark.sparkContext.broadcast((model.flat(), to_model))

        def run(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            voc, (flat, to_model) = shared.value, current.value
            local = GRU(frequent).load(flat)
            end = voc.index.get(END, 0)
            encode = Encoder(voc, to_model, frequent)
            docs = (d for batch in batches for part in split_words(batch) for d in encode(*part).documents())
            if seen := train_on(local, docs, end):
                p = local.flat()
                parts = [p[i : i + SLICE].tobytes() for i in range(0, len(p), SLICE)]
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["slice", "task", "n", "p"])

        part = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == r).select("text")
        trained = part.mapInArrow(run, "slice int, task int, n long, p binary")
        some = averaged(trained.withColumn("part", F.floor(F.col("task") / FAN).cast("int")), "part", "task")  # then all parts
        means = averaged(some.withColumn("task", F.col("part")).withColumn("part", F.lit(0)), "part", "task").collect()
        if means:
            model.load(np.concatenate([np.frombuffer(x["p"], np.float32) for x in sorted(means, key=lambda x: x["slice"])]))
    return model


def log_likelihoods(model: GRU, docs: list[np.ndarray], end: int, side: int = 1 << 11, window: int = 1 << 15) -> np.ndarray:
    """ln of the class and word probabilities of whole documents, many side by side, longest first."""
    out = np.zeros(len(docs))
    xw = model.inputs()
    lengths = np.array([len(d) for d in docs], np.int64)
    by = np.argsort(-lengths, kind="stable")
    for a in range(0, len(by), side):
        mine = by[a : a + side]
        long = lengths[mine]
        flat, first = np.concatenate([docs[i] for i in mine]), np.cumsum(long) - long
        live = np.searchsorted(-long, -np.arange(int(long[0])), side="left")  # documents longer than t
        upto = np.cumsum(live)
        h, lo = np.zeros((len(mine), model.hidden), np.float32), 0
        while lo < len(live):  # steps of a window
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + window)))
            n = live[lo:hi]
            ends = np.cumsum(n)
            who = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
            at = first[who] + np.repeat(np.arange(lo, lo + len(n)), n)
            before = flat[at - 1]
            if not lo:
                before[: n[0]] = end
            x, hs = np.take(xw, before, axis=0), np.empty((len(at), model.hidden), np.float32)
            for i, j in zip((ends - n).tolist(), ends.tolist()):
                h, _ = model.step(x[i:j], h[: j - i])
                hs[i:j] = h
            ln, _ = model.output(hs, flat[at])
            out[mine] += np.bincount(who, ln, len(mine))
            lo = hi
    return out


def score(docs: DataFrame, train_rows: DataFrame, *, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, text) to doc_id, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    counts = stored(count_words(train_rows), "counts")
    v = Vocabulary.of(counts, frequent)
    model = train(train_rows, v, frequent=frequent)
    spark = docs.sparkSession
    shared, weights = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast((model.flat(), v.model_ids(frequent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        voc, (flat, to_model) = shared.value, weights.value
        local, end = GRU(frequent).load(flat), voc.index.get(END, 0)
        of_count = np.append(np.log10(voc.counts + 1.0), 0.0)  # the last: not in the broadcast vocabulary
        per_token, rare = np.log10(voc.total + voc.distinct + 1.0), np.log10(voc.rare_mass)
        encode, row = Encoder(voc, to_model, frequent), TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for part in split_words(batch):
                e, n = encode(*part), len(part[1])
                logs, inside = of_count[e.at], e.ids >= frequent
                sums = [np.add.reduceat(v, e.first) if n else np.zeros(0, v.dtype) for v in (np.ones(len(e.at), np.int64), (e.at >= 0).astype(np.int64), logs - per_token, np.where(inside, logs - rare[np.where(inside, e.ids - frequent, 0)], 0))]
                sums[3] += log_likelihoods(local, e.documents(), end) / np.log(10)
                rows = np.arange(row, row + n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, n), pa.array(rows), *map(pa.array, sums), e.unknown], ["doc_id", "row", "n_tokens", "n_known", "base_score", "score", "rest"])
                row, done = row + n, done + n

    kind = docs.schema["doc_id"].dataType.simpleString()
    direct = stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, n_known long, base_score double, score double, rest array<struct<word:binary,n:bigint>>"), "scores")
    each = direct.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.n")
    rest = each.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("logs"))
    zero = F.lit(0.0)
    return direct.drop("rest").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("logs", zero)).alias("base_score"), (F.col("score") + F.coalesce("logs", zero)).alias("score")
    )


def op7_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    scored = score(docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

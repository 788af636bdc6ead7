"""Language ID by mixture inference.

A language is a distribution over hashed byte n-grams, counted over all training
rows. A document is a mixture of languages: expectation-maximisation estimates the
proportions from the likelihoods of its n-grams, for the likeliest language alone,
the likeliest two, three and so on, and the set with the best penalised likelihood
is kept: each more language costs the log of the n-gram count. The search takes languages in
order of their proportions among all, and ends at the first that doesn't pay; EM ends when no
proportion moves by 0.0001, after ``STEPS`` steps at the latest. The prediction is the
language with the largest proportion, which is the score.

Defined results: a null text, or one without a letter, is ``und`` with score 0; very long
texts are taken whole; ties go to the language that sorts first; repeated rows are learned from
and predicted each; without any training row all texts are ``und``; an empty table gives no rows;
rows with a null language are not learned from; extra columns are ignored. The model is broadcast,
so over ``MOST_LANGUAGES`` languages are refused with a ValueError before any text is judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, crc_mod, pick, shielded, table, texts_of

GRAM = 4
BITS = 16
#: Buckets to a row while counts travel.
CHUNK = 1 << 12
#: Languages a model can hold; bounds what is broadcast to 64 MB.
MOST_LANGUAGES = 256
UNDETERMINED = "und"
#: Steps of EM at most.
STEPS = 50
#: How surely a text must be in no learned language to be rejected, in nats.
EVIDENCE = 30.0


#: ASCII letters to lower case, bytes of other letters as they are, all else to spaces.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in LOWER)


def grams(text: bytes, n: int = GRAM, bits: int = BITS) -> np.ndarray:
    """Hash of each byte n-gram of the words, one space between them, one before and two after: numbers and signs are no language."""
    b = np.frombuffer(b" " + b" ".join(text.translate(LETTERS).split()) + b"  ", np.uint8).astype(np.uint64)
    if len(b) < n:
        return np.zeros(0, np.int64)
    x = np.zeros(len(b) - n + 1, np.uint64)
    for k in range(n):
        x |= b[k : k + len(x)] << np.uint64(8 * k)
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def count_grams(train: DataFrame) -> DataFrame:
    """(text, lang) to lang, chunk and counts: the n-gram counts of each language over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, x in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                if lang not in totals:
                    totals[lang] = np.zeros(1 << BITS, np.int64)
                totals[lang] += np.bincount(grams(x or b""), minlength=1 << BITS)
        for lang, c in totals.items():
            parts = c.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["lang", "chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (lang, chunk): sums of each."""
        at, total = None, None
        for batch in batches:
            for lang, chunk, c in zip(batch.column("lang").to_pylist(), batch.column("chunk").to_pylist(), batch.column("counts")):
                if (lang, chunk) != at:
                    if at:
                        yield one(at, total)
                    at, total = (lang, chunk), np.zeros(CHUNK, np.int64)
                total = total + np.frombuffer(c.as_py(), np.int64)
        if at:
            yield one(at, total)

    def one(at: tuple[str, int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lang", "chunk", "counts"])

    schema = "lang string, chunk int, counts binary"
    return train.select("lang", "text").mapInArrow(run, schema).repartition("lang", "chunk").sortWithinPartitions("lang", "chunk").mapInArrow(add, schema)


class Mixture:
    """Languages and the log-likelihood of each n-gram under each."""

    def __init__(self, langs: list[str], counts: np.ndarray, floor: float = 0.01):
        self.langs = langs
        p = (counts + floor) / (counts.sum(1, keepdims=True) + floor * counts.shape[1]) if len(langs) else np.zeros((0, 1 << BITS))
        self.p = np.ascontiguousarray(p.T, np.float64)  # a row for each n-gram

    @classmethod
    def fit(cls, train: DataFrame) -> Mixture:
        """Learn from (text, lang). The driver gets a fixed number of counts a language, at most MOST_LANGUAGES languages."""
        known = [r[0] for r in train.where("lang is not null").select("lang").distinct().sort("lang").limit(MOST_LANGUAGES + 1).collect()]
        if len(known) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        counts = np.zeros((len(known), 1 << BITS), np.int64)
        if known:
            at = {x: i for i, x in enumerate(known)}
            for lang, chunk, c in count_grams(train.where("lang is not null")).toLocalIterator():
                counts[at[lang], chunk * CHUNK : (chunk + 1) * CHUNK] += np.frombuffer(c, np.int64)
        return cls(known, counts)

    def infer(self, text: bytes, steps: int = STEPS) -> tuple[str, float, dict[str, float], float]:
        """Language, score, the proportions of the chosen set, and its log-likelihood less that of uniform n-grams."""
        if not self.langs or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            return UNDETERMINED, 0.0, {}, 0.0
        seen = np.bincount(grams(text), minlength=1 << BITS)
        where = np.flatnonzero(seen)
        weight = seen[where].astype(np.float64)
        p, n = self.p[where], weight.sum()
        theta = self._climb(p, weight, np.full(len(self.langs), 1 / len(self.langs)), steps)
        order = np.argsort(-theta, kind="stable")
        best, chosen, gain = -np.inf, None, 0.0
        for k in range(1, len(order) + 1):
            own = np.sort(order[:k])
            q = np.ascontiguousarray(p[:, own])
            t = np.ones(1) if k == 1 else self._climb(q, weight, theta[own] / theta[own].sum(), steps) if k < len(order) else theta
            log = float(weight @ np.log(q @ t))
            fit = log - (k - 1) * np.log(n)
            if fit <= best:
                break
            best, chosen, gain = fit, (own, t), log + n * BITS * np.log(2)
        own, t = chosen
        i = int(np.argmax(t))
        return self.langs[own[i]], float(min(1.0, t[i])), {self.langs[j]: float(x) for j, x in zip(own, t)}, gain

    @staticmethod
    def _climb(p: np.ndarray, weight: np.ndarray, theta: np.ndarray, steps: int) -> np.ndarray:
        """EM for the proportions, until they stand still or the steps are used up."""
        theta = np.maximum(theta, 1e-12)
        for _ in range(steps):
            new = theta * ((weight / (p @ theta)) @ p)
            new /= new.sum()
            still = np.abs(new - theta).max() < 1e-4
            theta = np.maximum(new, 1e-12)
            if still:
                break
        return theta / theta.sum()


def identify(docs: DataFrame, model: Mixture, *, keep: tuple[str, ...] = ("doc_id",), proportions: bool = False) -> DataFrame:
    """``keep`` columns with lang_pred and score, and with ``proportions`` a map of them and the gain over uniform n-grams."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if proportions:
        schema = schema.add("proportions", T.MapType(T.StringType(), T.DoubleType())).add("gain", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.infer(x) if x is not None else (UNDETERMINED, 0.0, {}, 0.0) for x in texts_of(batch)]
            columns = [*[batch.column(c) for c in keep], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if proportions:
                columns += [pa.array([list(x[2].items()) for x in found], pa.map_(pa.string(), pa.float64())), pa.array([x[3] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out quarter."""
    return docs.where(crc_mod("doc_id", 4) != 2).where("lang is not null").select("text", "lang")


def keep_language(docs: DataFrame, model: Mixture) -> DataFrame:
    """docs less those in no learned language: undetermined, or with uniform n-grams likelier than any mixture by e to the EVIDENCE. Where no language was learned, those without a letter."""
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    docs, restore = shielded(docs, "text")
    found = identify(docs, model, keep=tuple(docs.columns), proportions=True)
    return restore(found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("gain") > -EVIDENCE)))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    found = identify(docs, Mixture.fit(training_rows(docs)))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

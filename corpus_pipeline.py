"""A corpus pipeline of five stages, each an operator of ``terrasieve.llm`` whose decisions take effect.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of ``documents``; the last returns the tokens. Stage results are
written as Parquet and read again.

Defined results, in all stages: null, empty and letterless texts go with the first stage;
other nulls stay as they are; texts are taken whole, however long; of repeated rows the
near-duplicate stage keeps one, and ties go to the least doc_id (null last); empty tables give
empty results, an empty benchmark takes nothing away; columns beyond those of ``documents``
are dropped by the first stage, so none clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.llm import align, bpe, mixture, simhash, suffixes
from terrasieve.llm.common import pick, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are undetermined or in no language of the labelled rows."""
    docs = pick(docs, *COLUMNS)
    return mixture.keep_language(docs, mixture.Mixture.fit(mixture.training_rows(docs)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes blocks of lines that an earlier document has; documents left with nothing go."""
    done = align.delete_blocks(pick(docs, *COLUMNS))
    left = done.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id: those near in one of eight tables of two-word shingles."""
    return simhash.keep_first(pick(docs, *COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents with a ten-word window of any benchmark item."""
    return suffixes.clean(pick(docs, *COLUMNS), pick(table(spark, sf_dir, "benchmark"), "item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text, with digests of ids and of the text decoded from them."""
    import public_tokenizers as P

    done = bpe.encode_decode(pick(docs, "doc_id", "text"), bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("tokens", tokens)]

#: Mixtures, patience diff, XXH64 and BPE are beyond SQL; tests hold the operators against brute force, and the stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: stages keep the columns of documents, and what each drops is what it should."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
R = random.Random(3)


def text(n: int) -> str:
    return " ".join("".join(R.choices(["ther", "ing", "of", "and", "stone", "er", "al"], k=R.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipe")
    passage, item = [text(15) for _ in range(5)], text(14)
    docs = [(i, text(60), "en") for i in range(40)]
    docs += [(100, "\n".join(passage), "en"), (101, text(20) + "\n" + "\n".join(passage) + "\n" + text(20), "en"), (102, "\n".join(passage), "en")]
    docs += [(110, text(10) + " " + item + " " + text(10), "en"), (120, None, "en"), (121, "12 34 !!", "en"), (122, "ъщж " * 60, None), (123, "", None)]
    near = text(400)
    docs += [(130, near, "en"), (131, near + " x", "en")]
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "lines", "near_duplicates", "decontaminate", "tokens"]
    one = stage["language"](spark, docs, sf)
    assert ids(docs) - ids(one) == {120, 121, 122, 123} and one.columns == list(corpus_pipeline.COLUMNS)
    two = stage["lines"](spark, one, sf)
    assert ids(one) - ids(two) == {102} and two.columns == one.columns
    changed = two.where("doc_id = 101").first()
    assert changed.text.count("\n") == 1 and changed.n_chars == len(changed.text)
    three = stage["near_duplicates"](spark, two, sf)
    assert ids(two) - ids(three) == {131}
    four = stage["decontaminate"](spark, three, sf)
    assert ids(three) - ids(four) == {110}
    assert ids(corpus_pipeline.run(spark, sf)) == ids(four)


def test_near_duplicates_catches_near_copies(spark, tmp_path):
    """Of copies that share 0.8 of their five-word shingles nine of ten go; others all stay."""
    r = random.Random(11)
    pool = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(3000)]
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    docs, near = [], set()
    for i in range(120):
        w = r.choices(pool, k=r.randint(60, 300))
        v = [r.choice(pool) if r.random() < 0.02 else x for x in w]
        a, b = " ".join(w), " ".join(v)
        docs.append((i, a))
        if a != b and len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) >= 0.8:
            docs.append((1000 + i, b))
            near.add(1000 + i)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()}
    assert len(near) > 60 and len(near - kept) >= 0.9 * len(near) and {i for i, _ in docs if i < 1000} <= kept


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nothing in them, and tables of repeated rows, ties, a very long text and columns whose names clash."""
    path = tmp_path_factory.mktemp("odd")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{path}/empty/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/empty/benchmark.parquet")
    long = "\n".join(text(12) for _ in range(8000))
    same = text(50)
    rows = [(1, same, "en", "s", 1), (1, same, "en", "s", 1), (2, same, "en", None, None), (3, long, "en", "s", None), (None, text(40), "en", "s", 3), (5, text(40), None, "s", 3), (6, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, schema)
    for name in ("fp", "root", "n_removed", "lines", "hit", "TEXT_", "t_"):
        docs = docs.withColumn(name, docs.doc_id)
    docs.write.parquet(f"{path}/odd/documents.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, text(13)), (2, text(13))], "item_id long, text string").write.parquet(f"{path}/odd/benchmark.parquet")
    return str(path), long


def test_pipeline_on_empty_tables(spark, odd):
    assert corpus_pipeline.run(spark, f"{odd[0]}/empty").count() == 0
    docs = spark.read.parquet(f"{odd[0]}/empty/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"{odd[0]}/empty").columns == list(corpus_pipeline.COLUMNS), name


def test_pipeline_on_repeated_rows_ties_long_texts_and_clashing_columns(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{odd[0]}/odd")
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == {1, 3, 5, None} and left[3] == odd[1] and docs.count() == 4
    got = corpus_pipeline.run(spark, f"{odd[0]}/odd").collect()
    assert {r.doc_id for r in got} == set(left)

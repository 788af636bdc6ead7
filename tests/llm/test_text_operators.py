"""The text operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from terrasieve.llm import align, bpe, gru, jump, mixture, mpeg, phrases, registry, simhash, suffixes, wavelet
from terrasieve.llm.common import LOWER

P = pytest.importorskip("public_tokenizers")
R = random.Random(5)
WORDS = ["the", "of", "harbour", "grain", "Émile", "x1", "rain.", "Nord,", "und", "wind", "stone", "12", "a"]


def sentence(n: int) -> str:
    return " ".join(R.choices(WORDS, k=n))


def corpus() -> list[tuple[int | None, str | None]]:
    shared, other = sentence(120), "\n".join(sentence(12) for _ in range(6))
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "   \n "), (4, shared), (5, shared), (6, shared[:300] + " new " + shared[300:])]
    rows += [(7, other), (8, other + "\nThe end of it all, is it not so"), (9, sentence(3)), (10, "aaaa" * 300), (11, "aaaa" * 301), (12, sentence(9) + " " + shared + " " + sentence(9))]
    rows += [(20 + i, sentence(R.randint(1, 90))) for i in range(30)]
    rows += [(60, sentence(12_000)), (61, "日本語のテキスト" * 80), (62, "　\x1c  \t"), (63, "😀 naïve 's  'S\n\n x"), (64, "a"), (64, "a"), (65, "a"), (None, "no id"), (None, None)]
    return rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder of tables with columns whose names clash, one of them by case only."""
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(d, t, ["de", "en", None][i % 3], "s", len(t or ""), f"f{i}", i) for i, (d, t) in enumerate(corpus())], "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, row long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(1, sentence(14)), (2, corpus_text(4)[:200]), (3, "rain. 12"), (4, None), (5, " . "), (6, corpus_text(4)[:200]), (10, corpus_text(7)[:150])]
    spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


_texts = corpus()


def corpus_text(doc_id: int) -> str:
    return next(t for d, t in _texts if d == doc_id) or ""


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


def as_multiset(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_op1_matches_brute_force(spark, sf, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = Counter(brute_windows(rows, items))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert as_multiset(registry.QUERIES["op1_suffix_decontamination"](spark, sf), *columns) == want
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    in_blocks = suffixes.report(docs, bench, block_bytes=150, shard_bytes=500)  # several passes, many small shards
    assert as_multiset(in_blocks, *columns) == want
    clean = suffixes.clean(docs, bench)
    assert clean.count() == sum(n for x, n in want.items() if not x[5])


def words_of(t):
    return suffixes.words_of((t or "").encode())


def brute_windows(rows, items, width=10):
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    for d, t in rows:
        w, found = words_of(t), set()
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    found |= x
                    hit[k : k + n] = [1] * n
        yield d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0


def test_suffix_arrays_are_sorted_and_longest_matches_found(spark, sf):
    r = np.random.default_rng(1)
    ids = np.concatenate([r.integers(1, 4, 400), [0], r.integers(1, 4, 300), [0]])
    at = np.flatnonzero(ids > 0)
    sa = suffixes.suffix_array(ids, at, 1000, 6)
    seqs = [tuple(ids[i : i + np.flatnonzero(ids[i:] == 0)[0]]) for i in sa]
    assert seqs == sorted(seqs) and sorted(sa) == sorted(at)
    docs = spark.createDataFrame([(1, "q w e one two three four five z"), (2, None)], "doc_id long, text string")
    found = suffixes.find(docs, spark.createDataFrame([("k", "zero one two three four five six")], "item_id string, text string"), window=3)
    assert [tuple(m) for r in found.where("doc_id = 1").collect() for m in r.matches] == [("k", 1, 3, 5)]


def test_op1_longest_matches_equal_brute_force(spark):
    r = random.Random(6)
    items = [(str(k), " ".join(r.choices("abc", k=r.randint(1, 9)))) for k in range(8)]
    docs = [(k, " ".join(r.choices("abcd", k=r.randint(0, 60)))) for k in range(25)]
    got = suffixes.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=3).collect()
    for row in got:
        d = dict(docs)[row.doc_id].split()
        want = {}
        for k, t in items:
            w = t.split()
            best = max(((n, -b, -a) for a in range(len(w)) for b in range(len(d)) for n in range(min(3, len(w)), len(w) - a + 1) if d[b : b + n] == w[a : a + n]), default=None)
            if best:
                want[k] = (best[0], -best[1])
        assert {m.item_id: (m.words, m.doc_word) for m in row.matches} == want
        assert all(d[m.doc_word : m.doc_word + m.words] == dict(items)[m.item_id].split()[m.item_word : m.item_word + m.words] for m in row.matches)


def test_op2_round_trip(spark, sf, rows):
    got = registry.QUERIES["op2_mpeg_media"](spark, sf)
    want = Counter()
    for d, t in rows:
        x = (t or "").encode()
        p = x + bytes(max(64, -(-len(x) // 64) * 64) - len(x))
        want[d, len(x), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert as_multiset(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    for r in got.collect():
        assert "vbr_ok=1;bad_crc=0;resyncs=0" in r.feature
        assert len(r.frame_offsets) == -(-r.payload_bytes // 1413) and r.duration == len(r.frame_offsets) * 1152 / 32000
        x = next(t for d, t in rows if d == r.doc_id and len((t or "").encode()) == r.n_bytes)
        data = mpeg.write_mpeg(mpeg.padded((x or "").encode()))
        assert r.media_bytes == len(data) and all(data[o : o + 2] == b"\xff\xfa" for o in r.frame_offsets)


def test_mpeg_streams_resynchronise_and_report_damage():
    p = R.randbytes(5000)
    data = mpeg.write_mpeg(p)
    s = mpeg.read_mpeg(data)
    assert s.payload == p and s.xing_frames == len(s.offsets) == 4 and s.seconds == (4 * 1152, 32000)
    assert [data[o : o + 2] for o in s.offsets] == [b"\xff\xfa"] * 4
    cut = mpeg.read_mpeg(data[: s.offsets[2]] + b"\x00junk\xff\xfb\x90" + data[s.offsets[2] :])
    assert cut.payload == p and cut.resyncs == 1 and cut.skipped == 8
    hurt = bytearray(data)
    hurt[s.offsets[1] + 5] ^= 1
    assert mpeg.read_mpeg(bytes(hurt)).bad_crc == 1 and s.table_ok and not cut.table_ok
    for at in (s.xing_at + 21 + 8, s.xing_at + 21 + 12, s.xing_at + 21 + 17 + 50):  # count of frames, of bytes, seek table
        wrong = bytearray(data)
        wrong[at + 2] ^= 1
        assert mpeg.read_mpeg(bytes(wrong)).payload == p and not mpeg.read_mpeg(bytes(wrong)).table_ok
    tagged = data + b"TAG" + b"Title".ljust(125, b"\0")
    assert mpeg.read_mpeg(tagged).tags["TIT2"] == "Title" and mpeg.read_mpeg(tagged).payload == p
    assert mpeg.read_mpeg(b"").seconds == (0, 1) and mpeg.read_mpeg(b"\xff" * 50).offsets == []


def test_op3_on_held_out_rows_and_edges(spark, sf):
    got = {r.doc_id: r for r in registry.QUERIES["op3_language_mixture"](spark, sf).where("doc_id is not null").collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 62)] == ["und"] * 4 and all(got[i].score == 0 for i in (1, 2, 3, 62))
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    syllables = {"aa": ["ba", "ko", "lu"], "bb": ["sch", "ein", "ung"], "cc": ["eau", "tion", "oi"]}
    text = lambda lang, n: " ".join("".join(R.choices(syllables[lang], k=3)) for _ in range(n))
    data = [(i, text(lang, R.randint(5, 60)), lang) for i, lang in enumerate(R.choices(list(syllables), k=300))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = mixture.Mixture.fit(mixture.training_rows(docs))
    found = mixture.identify(docs, model, keep=("doc_id", "lang")).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    mixed = model.infer((text("aa", 60) + " " + text("bb", 20)).encode())
    assert set(mixed[2]) == {"aa", "bb"} and 0.6 < mixed[2]["aa"] < 0.85
    assert model.infer(text("cc", 40).encode())[2].keys() == {"cc"}
    assert mixture.Mixture.fit(docs.where("doc_id < 0")).infer(b"abc") == ("und", 0.0, {}, 0.0)
    kept = mixture.keep_language(docs.union(spark.createDataFrame([(999, "zxqj wvkp " * 30, "aa")], docs.schema)), model)
    assert kept.count() == len(data)
    unlabelled = spark.createDataFrame([(1, "abc", None), (2, "12", None), (3, None, None)], docs.schema)
    assert [r.doc_id for r in mixture.keep_language(unlabelled, mixture.Mixture.fit(unlabelled)).collect()] == [1]


def test_mixture_finds_the_proportions_a_grid_search_finds():
    r = np.random.default_rng(2)
    words = {"aa": "stone harbour wind grain".split(), "bb": "pierre vent moisson quai".split(), "cc": "hafen korn sturm stein".split()}
    counts = np.array([np.bincount(mixture.grams(" ".join(r.choice(w, 3000)).encode()), minlength=1 << mixture.BITS) for w in words.values()])
    m = mixture.Mixture(list(words), counts)
    for share in (0.0, 0.25, 0.5, 0.8):
        text = " ".join([*r.choice(words["aa"], round(400 * (1 - share))), *r.choice(words["bb"], round(400 * share))]).encode()
        lang, score, proportions, _ = m.infer(text)
        seen = np.bincount(mixture.grams(text), minlength=1 << mixture.BITS)
        where = np.flatnonzero(seen)
        fit = lambda t: float(seen[where] @ np.log(m.p[where] @ t))
        grid = max((fit(np.array([1 - t, t, 0.0])), t) for t in np.linspace(0, 1, 401))[1]
        n = seen.sum()
        best = {}  # of each set of languages, by a grid: the penalised likelihood
        for own in ([0], [0, 1], [0, 1, 2]) if share < 0.5 else ([1], [0, 1], [0, 1, 2]):
            shares = [np.eye(3)[own[0]]] if len(own) == 1 else [np.array([1 - t, t, 0.0]) * (1 - u) + np.array([0, 0, u]) for t in np.linspace(0, 1, 101) for u in ([0.0] if len(own) == 2 else np.linspace(0, 0.2, 21))]
            best[len(own)] = max(map(fit, shares)) - (len(own) - 1) * np.log(n)
        assert len(proportions) == max(best, key=best.get) == (2 if share else 1)
        assert abs(proportions.get("bb", 0.0) - grid) < 0.01 and lang == ("bb" if share > 0.5 else "aa" if share < 0.5 else lang) and score == max(proportions.values())


def brute_components(fps, distance=4):
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f, least.get(find(f))) for d, f in fps}


def test_op4_matches_brute_force(spark, sf, rows):
    import xxhash

    def slow(t):
        w = (t or "").encode().translate(LOWER).split()
        grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 4 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = brute_components([(d, slow(t)) for d, t in rows])
    got = registry.QUERIES["op4_simhash"](spark, sf).collect()
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_links_join_all_that_is_near_also_in_tiles(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "TILE", 16)
    base = [R.getrandbits(64) for _ in range(6)]
    fps = [(i, base[i % 6] ^ sum(1 << b for b in R.sample(range(64), R.randint(0, 5)))) for i in range(300)]
    signed = [(i, simhash._signed(f)) for i, f in fps]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    links = simhash.near_links(df.selectExpr("0 as tab", "fp").distinct(), 4, blocks)
    roots = {r.node: r.root for r in simhash.components(links.select("a", "b")).collect()}
    want = brute_components(fps)
    mine: dict[int, int] = {}
    for i, f in signed:
        k = roots.get(f, f)
        mine[k] = min(i, mine.get(k, i))
    assert {(i, f, mine[roots.get(s, s)]) for (i, f), (_, s) in zip(fps, signed)} == want


def test_keys_added_up_in_batches_count_every_row():
    r = np.random.default_rng(8)
    tab, fp, masks = r.integers(0, 3, 500).astype(np.int32), r.integers(-(1 << 63), 1 << 63, 500), [-(1 << 60), 0xF, 0]
    parts = [pa.RecordBatch.from_pydict({"tab": tab[i:j], "fp": fp[i:j]}) for i, j in ((0, 0), (0, 200), (200, 500))]
    got: Counter = Counter()
    for batch in simhash.block_counts(iter(parts), masks):
        for row in batch.to_pylist():
            got[row["tab"], row["path"], row["key"]] += row["n"]
    want = Counter((int(t), p, int(f) & m) for t, f in zip(tab, fp) for p, m in enumerate(masks))
    assert got == want
    keyed = pa.RecordBatch.from_pydict({"tab": tab, "path": np.zeros(500, np.int64), "key": fp & 0xF})
    assert {(x["tab"], x["key"]): x["n"] for b in simhash.key_counts(iter([keyed])) for x in b.to_pylist()} == Counter(zip(tab.tolist(), (fp & 0xF).tolist()))


def test_a_hot_key_is_cut_by_further_blocks(spark):
    """100,000 fingerprints that share half their bits: the same links as all pairs, and rows in proportion."""
    r = np.random.default_rng(4)
    low = r.integers(0, 1 << 32, 100_000, dtype=np.uint64)
    low[50_000:50_400] = low[:400] ^ (np.uint64(1) << r.integers(0, 32, 400).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 32, 400).astype(np.uint64))
    fps = np.unique(low | np.uint64(0xABCD1234 << 32)).view(np.int64)
    df = spark.createDataFrame(pa.table({"fp": fps}).to_pandas())
    links = {frozenset((e["a"], e["b"])) for e in simhash.near_links(df.selectExpr("0 as tab", "fp"), 4).distinct().toArrow().to_pylist()}
    x, want = fps.view(np.uint64), set()
    for mask in (0xFF, 0xFF00, 0xFF0000, 0xFF000000):  # near in 32 bits, at distance 2: one of four bytes agrees
        order = np.argsort(x & np.uint64(mask), kind="stable")
        y = x[order]
        for lag in range(1, 600):
            a, b = y[lag:], y[:-lag]
            near = (np.bitwise_count(a ^ b) <= 2) & ((a & np.uint64(mask)) == (b & np.uint64(mask)))
            want |= {frozenset(p) for p in zip(a[near].view(np.int64).tolist(), b[near].view(np.int64).tolist())}
    root = {}

    def find(v):
        while root.get(v, v) != v:
            v = root[v]
        return v

    for u, v in map(tuple, links):
        assert bin((u ^ v) & (1 << 64) - 1).count("1") <= 4
        root[find(u)] = find(v)
    assert len(want) >= 390 and all(find(u) == find(v) for u, v in map(tuple, want))
    rows = sum(b.num_rows for b in simhash.split(iter([pa.RecordBatch.from_pydict({"tab": pa.array(np.zeros(1000, np.int32)), "combo": pa.array(np.zeros(1000, np.int32)), "path": pa.array(np.zeros(1000, np.int64)), "used": pa.array(np.full(1000, -1 << 32)), "key": pa.array(np.zeros(1000, np.int64)), "fp": pa.array(fps[:1000])})]), 4))
    assert rows == 15_000


def test_pipeline_tables_find_nine_of_ten_near_copies():
    """Copies with words exchanged so that 0.8 or more of the five-word shingles are shared."""
    r, found, total, far = random.Random(8), 0, 0, 0
    pool = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(3000)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    near = lambda a, b: any(bin(x ^ y).count("1") <= 4 for x, y in zip(a, b))
    of = lambda w: simhash.fingerprint(" ".join(w).encode(), 2, tables=8)
    last = None
    for _ in range(150):
        w = r.choices(pool, k=r.randint(60, 400))
        v = [r.choice(pool) if r.random() < 0.02 else x for x in w]
        a, b = shingles(w), shingles(v)
        if len(a & b) / len(a | b) >= 0.8:
            total += 1
            found += near(of(w), of(v))
        far += last is not None and near(of(w), last)
        last = of(w)
    assert total > 80 and found >= 0.9 * total and far == 0


def test_keep_first_keeps_one_row_of_each_group(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = simhash.keep_first(docs, k=4, tables=1).collect()
    groups = {(r.root) for r in simhash.near_duplicates(docs.select("doc_id", "text")).collect()}
    assert len(kept) == len(groups) and sum(r.doc_id == 64 for r in kept) == 1 and not any(r.doc_id in (5, 65) for r in kept)


def test_op5_equals_tiktoken(spark, sf, rows):
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t in rows:
        ids = np.array(plain.encode_ordinary(t or ""), "<u4")
        want[d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert as_multiset(registry.QUERIES["op5_byte_bpe"](spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    coder = bpe.PieceBPE(bpe.model_proto(ranks), P.PATTERN)
    marks = [" ", "  ", "\n", "\t", "\x1c", "\xa0", "　", "\x85", "a", "B", "é", "12", "'s", "!", "<unk>", "<|endoftext|>", "▁", "😀", "́", "\x00", "\r"]
    texts = ["".join(R.choices(marks, k=R.randint(0, 9))) for _ in range(3000)]
    assert coder.encode(texts) == [np.array(plain.encode_ordinary(x), "<u4").tobytes() for x in texts]
    assert [coder.decode(x).decode() for x in coder.encode(texts)] == texts


def test_op6_reads_back_what_the_tokenizer_gave(spark, sf, rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    start, want = 0, Counter()
    got = registry.QUERIES["op6_wavelet_ids"](spark, sf).collect()
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    for d, t in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes()), int((ids == 0).sum())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, r.n_end) for r in got) == want
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("n,high", [(0, 5), (1, 1), (7, 2), (511, 9), (512, 300), (5000, 70_000), (3000, 3)])
def test_wavelet_matrix(n, high):
    r = np.random.default_rng(n)
    ids = r.integers(0, high, n).astype("<u4")
    x = wavelet.read_shard(wavelet.write_shard(ids, np.array([0, n]), [None]))
    assert (x.decode() == ids).all() and x.doc_ids == [None]
    for i in r.integers(0, n, 20) if n else []:
        assert x.access(int(i)) == ids[i]
    for token in [*ids[:5].tolist(), high + 1]:
        at = np.flatnonzero(ids == token).tolist()
        assert x.count(token) == len(at) and x.find(token) == at
        if at:
            place = x._place(token)
            assert x.matrix.rank(place, at[-1]) == len(at) - 1 and x.matrix.select(place, len(at) - 1) == at[-1]
            cuts = np.sort(r.integers(0, n + 1, 9))
            assert x.counts_in(token, cuts).tolist() == [int((ids[a:b] == token).sum()) for a, b in zip(cuts, cuts[1:])]


def test_wavelet_access_unpacks_only_what_it_touches(monkeypatch):
    monkeypatch.setattr(wavelet, "STRETCH", 256)
    ids = np.random.default_rng(1).integers(0, 1000, 100_000).astype("<u4")
    x = wavelet.read_shard(wavelet.write_shard(ids, np.array([0, len(ids)]), [7]))
    assert [x.access(i) for i in (0, 70_000, 99_999)] == ids[[0, 70_000, 99_999]].tolist()
    opened = [len(p.open) for p in x.matrix.planes]
    assert max(opened) <= 3 and all(p.whole is None for p in x.matrix.planes) and len(x.matrix.planes[0].frames) == 49
    assert x.count(5) == int((ids == 5).sum()) and x.find(5) == np.flatnonzero(ids == 5).tolist()
    assert (x.decode() == ids).all()


def test_op7_base_score_and_held_out_gain(spark, sf, rows):
    got = registry.QUERIES["op7_gru_scores"](spark, sf).collect()
    words = lambda t: [*gru.words_of((t or "").encode()), b""]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(words(t)), sum(w in c for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 4)) for d, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_gru_probabilities_sum_to_one_and_training_helps():
    words = [b"w%d" % i for i in range(90)]
    v = gru.Vocabulary({w: i for i, w in enumerate([b"", *words])}, np.arange(91, 0, -1), 4186, 91, np.ones(gru.RARE))
    m = gru.GRU(frequent=128)
    m.start_at_counts(v)
    h = np.random.default_rng(0).standard_normal((3, m.hidden)).astype(np.float32)
    m.p["wc"] += 0.1
    every = np.arange(91, dtype=np.int32)
    p = np.exp([m.output(np.repeat(h[i : i + 1], 91, 0), every)[0] for i in range(3)]).sum(1)
    rare = np.exp([m.output(np.repeat(h[i : i + 1], gru.RARE, 0), 128 + np.arange(gru.RARE, dtype=np.int32))[0] for i in range(3)]).sum(1)
    assert np.allclose(p + rare, 1, atol=1e-3)
    docs = [np.array([1 + (k + j) % 7 for j in range(40)] + [0], np.int32) for k in range(300)]
    before = gru.log_likelihoods(m, docs, 0).sum()
    gru.train_on(m, iter(docs * 4), 0, side=16)
    assert gru.log_likelihoods(m, docs, 0).sum() > 0.6 * before
    one = [gru.log_likelihoods(m, [d], 0)[0] for d in docs[:5]]
    assert np.allclose(one, gru.log_likelihoods(m, docs, 0)[:5], atol=1e-3)


def test_gru_gradients():
    m = gru.GRU(frequent=64, hidden=5)
    for k in ("wc", "ww", "bc", "bw"):
        m.p[k] = np.random.default_rng(3).standard_normal(m.p[k].shape).astype(np.float32) * 0.3
    m.p = {k: x.astype(np.float64) for k, x in m.p.items()}
    before, target = np.array([[1, 2], [3, 70], [5, 6]]), np.array([[3, 70], [5, 6], [2, 9]])

    def loss(grads=None):
        x = (m.p["emb"][before.reshape(-1)] @ m.p["wx"] + m.p["b"]).reshape(3, 2, -1)
        h, caches, hs = np.zeros((2, 5)), [], []
        for t in range(3):
            h, c = m.step(x[t], h)
            caches.append(c)
            hs.append(h)
        out, dh = m.output(np.concatenate(hs), target.reshape(-1), grads)
        if grads is not None:
            m.backward(before, caches, dh.reshape(3, 2, -1), grads)
        return -out.sum()

    grads = {k: np.zeros(x.shape) for k, x in m.p.items()}
    loss(grads)
    for k, at in (("u", (1, 3)), ("wx", (2, 7)), ("emb", (3, 1)), ("b", (4,)), ("wc", (0, 0)), ("ww", (0, 2, 5)), ("bw", (0, 6))):
        keep = m.p[k][at]
        m.p[k][at] = keep + 1e-4
        up = loss()
        m.p[k][at] = keep - 1e-4
        down = loss()
        m.p[k][at] = keep
        assert abs((up - down) / 2e-4 - grads[k][at]) < 1e-4, k


def test_gru_state_goes_over_every_cut():
    """A long document read in pieces begins each with the state and token that reading all before it leaves."""
    m = gru.GRU(frequent=64, hidden=5)
    docs = [np.random.default_rng(k).integers(1, 64, n).astype(np.int32) for k, n in enumerate((gru.PIECE * 3 + 5, 40, gru.PIECE * 2 + 7, gru.PIECE - 1))]
    docs = [np.append(d, np.int32(0)) for d in docs]
    got = {}
    for tokens, state, before in gru.pieces_of(m, docs, 0):
        got.setdefault(next(i for i, d in enumerate(docs) if any(np.array_equal(tokens, d[a : a + gru.PIECE]) for a in range(0, len(d), gru.PIECE))), []).append((tokens, state, before))
    for i, d in enumerate(docs):
        h, states = np.zeros((1, 5), np.float32), []
        for t, w in enumerate(np.concatenate([[0], d[:-1]])):
            if t % gru.PIECE == 0:
                states.append((h[0].copy(), int(w)))
            h, _ = m.step(m.inputs()[[w]], h)
        assert np.array_equal(np.concatenate([x for x, _, _ in got[i]]), d)
        for (_, state, before), (want, w) in zip(got[i], states):
            assert np.allclose(state, want, atol=1e-5) and before == w


def test_gru_training_does_not_depend_on_where_windows_cut(monkeypatch):
    """With parameters that stand still, one window, many windows and pieces give the same gradients but for truncation: here all of the first order, the bias of the output."""
    docs = [np.append(np.random.default_rng(k).integers(1, 64, 3 + 37 * k % 90).astype(np.int32), np.int32(0)) for k in range(25)]
    seen = []
    for steps, piece in ((200, 10_000), (7, 10_000), (16, 11)):
        monkeypatch.setattr(gru, "PIECE", piece)
        m, sums = gru.GRU(frequent=64, hidden=5), []
        for k in ("wc", "ww"):
            m.p[k] = np.random.default_rng(3).standard_normal(m.p[k].shape).astype(np.float32) * 0.3
        monkeypatch.setattr(gru.Adam, "update", lambda self, p, g: sums.append({k: x.copy() for k, x in g.items()}))
        due = []
        real = m.output
        m.output = lambda h, ids, grads=None: (due.append(len(ids)), real(h, ids, grads))[1]
        tokens = gru.train_on(m, iter(docs), 0, steps=steps, side=4096)
        assert tokens == sum(map(len, docs)) == sum(due) and len(sums) == 1
        seen.append(sums[0]["bc"])
    assert np.allclose(seen[0], seen[1], atol=1e-5) and np.allclose(seen[0], seen[2], atol=1e-5)


def test_gru_gains_on_held_out_text(spark):
    """Words that follow one another in a fixed order: the model scores held-out text above the base."""
    r = random.Random(1)
    circle = ["".join(r.choices("abcdefgh", k=4)) for _ in range(40)]
    docs = [(i, " ".join(circle[(s + k) % 40] for k in range(60))) for i in range(9000) for s in [r.randrange(40)]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = gru.score(df, df.where("doc_id % 7 <> 2")).where("doc_id % 7 = 2").groupBy().sum("score", "base_score").first()
    assert got[0] > 0.95 * got[1]


def test_a_local_work_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from terrasieve.llm import common

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.work_path(fake, "x")


def test_op7_score_equals_a_plain_loop(spark, sf, rows):
    """The score of every document, word by word: class, word in class, share of the count in a rare class."""
    train = [(d, t) for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for _, t in train for w in gru.words_of((t or "").encode()))
    counts[b""] = len(train)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    v = gru.Vocabulary.of(gru.count_words(spark.createDataFrame(train, "doc_id long, text string")))
    assert v.total == sum(counts.values()) and v.distinct == len(counts)
    small = 8  # frequent words, so that most words of the fixture are rare ones
    got = {(r.doc_id, r.n_tokens): r.score for r in gru.score(docs, docs.where("false"), frequent=small).collect()}
    m = gru.GRU(small)
    m.start_at_counts(gru.Vocabulary({}, np.zeros(0, np.int64), 0, 0, np.ones(gru.RARE)))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    p = {k: x.astype(float) for k, x in m.p.items()}
    for d, t in rows[:12]:
        h, before, total = np.zeros(m.hidden), 0, 0.0
        words = [*gru.words_of((t or "").encode()), None]
        for w in words:
            x = p["emb"][before] @ p["wx"] + p["b"]
            hu, n = h @ p["u"], m.hidden
            z, r = sigmoid(x[:n] + hu[:n]), sigmoid(x[n : 2 * n] + hu[n : 2 * n])
            new = np.tanh(x[2 * n :] + r * hu[2 * n :])
            h = new + z * (h - new)
            logits = h @ p["wc"] + p["bc"]
            word = small + gru.rare_class(w or b"")  # nothing is known: all words are rare
            cls = word - small + m.classes - gru.RARE
            total += logits[cls] - np.log(np.exp(logits).sum())
            before = word
        key = (d, len(words))
        if sum((x, len(gru.words_of((y or "").encode())) + 1) == key for x, y in rows) == 1:
            assert abs(got[key] - total / np.log(10)) < 1e-3 * len(words), key


def test_op8_laws(spark, sf, rows):
    got = registry.QUERIES["op8_jump_shards"](spark, sf).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots: dict[int, list[int]] = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    keys = np.random.default_rng(2).integers(0, 2**63, 20_000).astype(np.uint64)
    a, b = jump.jump(keys, 40), jump.jump(keys, 41)
    assert ((a == b) | (b == 40)).all() and abs((b == 40).mean() - 1 / 41) < 0.005 and np.bincount(a).min() > 350
    assert (jump.jump(keys, 1) == 0).all()


def brute_repeats(rows, length=400):
    seen = Counter()
    for _, t in rows:
        x = (t or "").encode()
        seen.update(x[i : i + length] for i in range(len(x) - length + 1))
    for d, t in rows:
        x = (t or "").encode()
        hit = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(b for b, h in zip(x, hit) if not h)
        spans = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        yield d, len(x), sum(hit), spans, hashlib.sha256(kept).hexdigest()


def test_op9_matches_brute_force(spark, sf, rows):
    few = [(d, (t or "")[:9000] if t else t) for d, t in rows]
    docs = spark.createDataFrame(few, "doc_id long, text string")
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert as_multiset(phrases.remove_repeats(docs), *columns) == Counter(brute_repeats(few))


def test_op9_on_many_shapes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 700)
    pool = [sentence(R.randint(20, 160)) for _ in range(12)]
    data = [(i, "".join(x[R.randint(0, 30) :] for x in R.choices(pool, k=R.randint(1, 5)))) for i in range(40)]
    data += [(90, "ab" * 900), (91, "x" * 400), (92, "x" * 399), (93, "ab" * 210), (93, "ab" * 210)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = phrases.remove_repeats(docs)
    assert as_multiset(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute_repeats(data))


def test_op10_deletes_from_the_later_document_only(spark, sf, rows):
    docs = spark.createDataFrame(
        [
            (1, "a long line of five words\nanother line with five words\nshort\nonly in the first one here"),
            (2, "its own line of many words\na long line of five words\nanother line with five words\n\nand its own end of words"),
            (3, "another line with five words\nshort\nnew line at the very end"),
            (4, None),
            (5, ""),
            (6, "short"),
            (7, "a long line of five words\nanother line with five words\nshort\nonly in the first one here"),
            (7, "a long line of five words\nanother line with five words\nshort\nonly in the first one here"),
        ],
        "doc_id long, text string",
    ).withColumnRenamed("text", "text")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in align.delete_blocks(docs).where("doc_id not in (4, 5)").collect())
    assert got[0][2] == 0
    assert got[1] == (2, "its own line of many words\n\nand its own end of words", 2)
    assert got[2] == (3, "new line at the very end", 2)
    assert got[3] == (6, "short", 0) and [x[2] for x in got[4:]] == [4, 4]
    done = registry.QUERIES["op10_line_alignment"](spark, sf).collect()
    assert len(done) == len(rows) and sum(r.n_removed for r in done) > 0


def test_clashing_columns_keep_their_values(spark):
    names = ["h", "items", "hit", "n_words", "t_", "n_", "fp", "root", "component_id", "gain", "lang_pred", "blocks", "kept", "k", "proportions"]
    rows = [(i, sentence(40 + i), "en", *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, "not in any of them")], "item_id long, text string")
    model = mixture.Mixture.fit(docs)
    for done in (align.delete_blocks(docs), suffixes.clean(docs, bench), simhash.keep_first(docs), mixture.keep_language(docs, model)):
        got = done.collect()
        assert len(got) == 6 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    taken = align.delete_blocks(docs.withColumnRenamed("h", "N_Removed"))
    assert [c for c in taken.columns if c.lower() == "n_removed"] == ["n_removed"] and taken.first().n_removed == 0


def test_patience_aligns_in_order():
    for _ in range(300):
        a, b = (R.choices(range(8), k=R.randint(0, 12)) for _ in range(2))
        pairs = align.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert align.patience([1, 2, 3, 4], [9, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def brute_deleted(docs: list[tuple[int, str]]) -> dict[int, list[int]]:
    """Lines of each document that stand in a block aligned with any earlier one."""
    split = {d: t.split("\n") for d, t in docs}
    gone = {}
    for d, b in split.items():
        blocks = [x for a in split if a < d for x in align.common_blocks(split[a], b, [len(x.split()) for x in b])]
        gone[d] = sorted({i for lo, hi in blocks for i in range(lo, hi)})
    return gone


def kept_lines(spark, docs: list[tuple[int, str]]) -> dict[int, str]:
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in align.delete_blocks(df).collect()}


def test_op10_finds_blocks_beyond_the_first_holder(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(6)) for c in "xyz")
    moved = [(1, f"{x}\n{y}\nfirst"), (2, f"{y}\nown\n{x}\nsecond"), (3, f"{y}\nother\n{x}")]
    assert kept_lines(spark, moved)[3] == "other"
    twice = [(1, f"{x}\na\n{x}\nb"), (2, f"c\n{x}\nd\n{x}\ne")]
    assert kept_lines(spark, twice)[2] == "c\nd\ne"
    short = [(1, "p q\nfirst"), (2, "r s\nsecond"), (3, "t u\nthird"), (4, f"{z}\np q\nr s\nt u\nlast"), (5, "own\np q\nr s\nt u\nend")]
    assert kept_lines(spark, short)[5] == "own\nend"


def test_op10_equals_all_pairs(spark):
    r = random.Random(5)
    lines = [f"w{i} {'v ' * (i % 6)}".strip() for i in range(9)] + ["", "long line number one of many words", "long line number two of many words"]
    docs = [(d, "\n".join([f"own {d}", *r.choices(lines, k=r.randint(1, 9))][d % 2 :])) for d in range(160)]
    gone, got = brute_deleted(docs), kept_lines(spark, docs)
    for d, t in docs:
        assert got[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), d


def test_longest_common_subsequence():
    for _ in range(200):
        a, b = (R.choices(range(3), k=R.randint(0, 30)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in ((i, j) for i in range(len(a)) for j in range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        pairs = align.longest_common(a, b)
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_gru_learns_from_rows_of_every_part(spark):
    rows = spark.range(400).selectExpr("id AS doc_id", "'the same few words again' AS text").where("pmod(xxhash64(doc_id), 24) >= 3")
    each = [r.doc_id for r in rows.selectExpr("pmod(xxhash64(doc_id), 24) AS part", "doc_id").groupBy("part").agg({"doc_id": "min"}).toDF("part", "doc_id").collect()]
    v = gru.Vocabulary.of(gru.count_words(rows.select("text")), 128)
    start = gru.GRU(128)
    start.start_at_counts(v)
    assert len(each) == 21 and gru.ROUNDS == gru.PARTS
    assert not np.array_equal(gru.train(rows, v, frequent=128).flat(), start.flat())
    one = spark.createDataFrame([(each[0], "the same few words again")], "doc_id long, text string")
    assert not np.array_equal(gru.train(one, v, frequent=128).flat(), start.flat())


def test_gru_words_by_columns_are_those_word_by_word(monkeypatch):
    """Splitting, places, ids, counts and unknown words of whole batches, whatever is split at once, against one word at a time."""
    every = "".join(chr(c) + "aB" * (c % 3) for c in range(128))
    texts = [None, "", " \t ", every, "Ä ÄB é\u00a0x\u3000y\u2028z \x85w", *[" ".join(R.choices(["Ab", "c", "zz", "q", "né", "\x1cx"], k=R.randrange(30))) + " " * (k % 2) for k in range(200)]]
    known = [b"", b"ab", b"c", "né".encode()]
    v = gru.Vocabulary({w: i for i, w in enumerate(known)}, np.arange(4, 0, -1), 10, 4, np.ones(gru.RARE))
    encode = gru.Encoder(v, v.model_ids(2), 2)
    for size, kind in ((7, pa.string()), (400, pa.large_string()), (1 << 22, pa.string())):
        monkeypatch.setattr(gru, "SPLIT", size)
        batch = pa.record_batch([pa.array([None, *texts], kind).slice(1)], ["text"])
        got = [encode(*part) for part in gru.split_words(batch)]
        docs, rest = [d for e in got for d in e.documents()], [r for e in got for r in e.unknown.to_pylist()]
        places = [p for e in got for p in np.split(e.at, e.first[1:])]
        assert len(docs) == len(rest) == len(places) == len(texts)
        for t, d, at, r in zip(texts, docs, places, rest):
            words = [*gru.words_of((t or "").encode()), b""]
            assert at.tolist() == [known.index(w) if w in known else -1 for w in words]
            assert d.tolist() == [known.index(w) if w in known[:2] else 2 + gru.rare_class(w) for w in words]
            assert {x["word"]: x["n"] for x in r} == Counter(w for w in words if w not in known) and len(r) == len({w for w in words if w not in known})


def test_gru_softmax_is_the_same_where_logits_are_shifted():
    h, r = np.random.default_rng(5).uniform(-1, 1, (40, 4)), np.random.default_rng(6)
    w, wide = gru.augmented(r.standard_normal((3, 3, 7)) * np.array([1, 1, 90])[:, None, None], r.standard_normal((3, 7)))
    assert wide.tolist() == [False, False, True]
    h[:, 3], at = 1, r.integers(0, 7, 40)
    for k in range(3):
        a = h @ w[k]
        p = np.exp(a - a.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = np.zeros_like(w[k])
        ln, dh = gru.softmax(h, w[k], wide[k], at, grad)
        e = p - np.eye(7)[at]
        assert np.allclose(ln, np.log(p[np.arange(40), at])) and np.allclose(ln, gru.softmax(h, w[k], wide[k], at)[0])
        assert np.allclose(grad, h.T @ e) and np.allclose(dh, (e @ w[k].T)[:, :3])


def test_op6_takes_added_tokens_as_the_library_does():
    from tokenizers import Tokenizer

    spec = open(P.path("byte_bpe_50k.json")).read()
    model, texts = Tokenizer.from_str(spec), ["one <|endoftext|> two", "a<|endoftext|>b  <|endoftext|>", None, "none of them", "<|endoftext|>"]
    want = [np.array(model.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(wavelet.Encoder(spec).encode(pa.array(texts))) == want


def test_mpeg_takes_no_tag_from_inside_a_frame():
    for n in (128, 640, 5000):
        p = bytearray(R.randbytes(n))
        data = mpeg.write_mpeg(bytes(p))
        at = len(data) - 128 - data.index(bytes(p[-60:])) + n - 60
        at = at if 0 <= at <= n - 3 else n - 3
        p[at : at + 3] = b"TAG"
        data = mpeg.write_mpeg(bytes(p))
        s = mpeg.read_mpeg(data)
        assert s.payload == bytes(p) and "TALB" not in s.tags and s.skipped == 0, n
    tagged = mpeg.read_mpeg(data[:-30] + b"TAG" + b"Title".ljust(125, b"\0"))  # the last frame is cut short by a tag
    assert tagged.tags["TIT2"] == "Title" and len(tagged.offsets) == len(s.offsets) - 1
    text = (b"x" * 29 + b"TAG").ljust(100, b"x")
    p = mpeg.padded(text)
    assert mpeg.write_mpeg(p)[-128:-125] == b"TAG" and mpeg.read_mpeg(mpeg.write_mpeg(p)).payload == p


def test_op9_orders_phrases_across_ranges(spark, monkeypatch):
    """One core under more different phrases than a range holds, so that shared suffixes reach over many ranges."""
    monkeypatch.setattr(phrases, "ranges_for", lambda df: 7)
    tail, stems = sentence(120)[:520], [sentence(60)[:290] for _ in range(6)]
    data = [(i, sentence(R.randint(5, 60)) + R.choice(stems)[R.randint(0, 280) :] + tail[: R.randint(300, 520)] + sentence(30)) for i in range(150)]
    data += [(200 + i, x) for i, (_, x) in enumerate(data[:5])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = phrases.remove_repeats(docs)
    assert as_multiset(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute_repeats(data))


def test_op9_shared_suffix_lengths_equal_all_pairs():
    left = sorted({"".join(R.choices("ab", k=R.randint(0, 9))).encode() for _ in range(80)})
    want = [sorted({len(os.path.commonprefix([a, b])) for b in left if b is not a}) for a in left]
    for cuts in ([], [1], [20, 21, 40], list(range(1, len(left)))):
        parts = [left[a:b] for a, b in zip([0, *cuts], [*cuts, len(left)])]
        lcp = lambda x, y: len(os.path.commonprefix([x, y]))
        ends, inside = [], []
        for k, part in enumerate(parts):
            ends.append({"pid": k, "first": {"core": 1, "left": part[0]}, "last": {"core": 1, "left": part[-1]}, "of_first": [lcp(part[0], x) for x in part], "of_last": [lcp(part[-1], x) for x in part]})
            shared = phrases.common(pa.array(part, pa.binary())).tolist()
            shared[0] = -1
            back = phrases.depths([-1, *shared[:0:-1]])[::-1]
            inside.append([{*a, *b} for a, b in zip(phrases.depths(shared), back)])
        got = []
        for (k, before, after), part, own in zip(phrases.across_ranges(ends), parts, inside):
            got += [sorted({*o, *[v for v in before if v <= lcp(x, part[0])], *[v for v in after if v <= lcp(x, part[-1])]}) for x, o in zip(part, own)]
        assert got == want


def test_op9_on_planted_passages_of_51_to_90_words(spark):
    """What of a planted passage goes is decided by its bytes: from 400 on all of it, below nothing."""
    lengths = list(range(51, 91, 3))
    passages = [" ".join(a + b * (k % 2) for k, (a, b) in enumerate(zip(R.choices(WORDS, k=n), R.choices(WORDS, k=n)))) for n in lengths]
    assert min(len(p.encode()) for p in passages) < 398 < max(len(p.encode()) for p in passages)
    data = [(i, sentence(80) + " | " + p + " | " + sentence(80)) for i, p in enumerate(passages)] + [(100 + i, sentence(70) + " + " + p + " + " + sentence(90)) for i, p in enumerate(passages)] + [(300 + i, sentence(170)) for i in range(20)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in phrases.remove_repeats(docs).collect()}
    for i, p in enumerate(passages):
        n = len(p.encode()) + 2  # the blanks around it are shared too
        assert found[i] == found[100 + i] == (n if n >= 400 else 0)
    assert not any(found[300 + i] for i in range(20))


def test_blocks_of_all_tables_are_never_on_disk_together(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} a{i} b{i} c{i} d{i} e{i}" if i % 3 else "the same words as others have") for i in range(30)], "doc_id long, text string")
    at_once, links = [], simhash.near_links

    def seen(distinct, *rest):
        at_once.append({r.tab for r in distinct.select("tab").distinct().collect()})
        return links(distinct, *rest)

    monkeypatch.setattr(simhash, "near_links", seen)
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == {0} | {i for i in range(30) if i % 3}
    assert max(map(len, at_once)) <= simhash.TABLES < 8 and set().union(*at_once) == set(range(8))

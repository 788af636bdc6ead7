"""Weighted clusters, Jaccard regions and prefix tries against brute force and their SQL, on odd rows and where every branch is taken."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.llm import centroids, jaccard, registry, trie

R = random.Random(7)


def multiset(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def of_sql(sql: str, **tables: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    done = con.execute(sql)
    columns = [x[0] for x in done.description]
    return columns, Counter(done.fetchall())


# weighted clusters

CLUSTERED = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) if abs(x) < 1e30 else int(float(x)) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digest = lambda v: hashlib.sha256(np.array(v, "<i4").tobytes() if max(map(abs, v)) < 1 << 31 else b"t" + ",".join(map(str, v)).encode()).digest()
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), digest(r[1])))[:k]
    cs = [list(v) for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(cs)), key=lambda j: (far(v, cs[j]), j))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for j in range(len(cs)):
            if own := [v for (_, v), c in zip(kept, of) if c == j]:
                cs[j] = [sum(x) // len(own) for x in zip(*own)]
    most = (1 << 63) - 1
    done = [(i, nearest(v), v) for i, v in kept]
    each = [min(far(v, cs[j]), most) for _, j, v in done]
    total = Counter()
    for (_, j, _v), d in zip(done, each):
        total[j] += d
    return Counter((i, j, d, min(total[j], most), min(sum(each), most), sha(",".join(map(str, cs[j])))) for (i, j, _), d in zip(done, each))


def vectors(spark, rows, tmp_path, kind="float"):
    df = spark.createDataFrame([(i, v, str(i), 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, k string, cluster int")
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def odd_vectors():
    point = lambda c: [c + R.randint(-40, 40) / 64 for _ in range(64)]
    rows = [(i, point(R.choice([-3.0, 0.0, 0.5, 4.0]))) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    rows += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 65), (2004, [None] + [0.5] * 63), (2005, [float("nan")] * 64), (2006, [float("inf")] + [0.0] * 63)]
    return rows + [(2007, [0.0] * 64), (2008, [-0.0] * 64), (-4, [-1 / 2048] * 64)]


def test_clusters_equal_brute_force_and_sql(spark, tmp_path):
    rows = odd_vectors()
    sf = vectors(spark, [*rows, (5, rows[7][1]), (5, rows[7][1])], tmp_path / "repeated")
    assert multiset(registry.QUERIES["op11_weighted_clusters"](spark, sf), *CLUSTERED) == brute_clusters(vectors_of(spark, sf))
    sf = vectors(spark, rows, tmp_path / "plain")
    got = multiset(registry.QUERIES["op11_weighted_clusters"](spark, sf), *CLUSTERED)
    assert got == brute_clusters(vectors_of(spark, sf))
    columns, want = of_sql(registry.SQL["op11_weighted_clusters"], embeddings=f"{sf}/embeddings.parquet")
    assert tuple(columns) == CLUSTERED and got == want


def vectors_of(spark, sf):
    return [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]


def test_clusters_of_few_and_of_very_large_vectors(spark, tmp_path):
    few = [(1, [1.0] * 64), (2, [1.0] * 64), (None, [2.0] * 64), (3, [2.5] * 64)]
    sf = vectors(spark, few, tmp_path / "few")
    assert multiset(registry.QUERIES["op11_weighted_clusters"](spark, sf), *CLUSTERED) == brute_clusters(few)
    large = [(i, [R.uniform(-1, 1) * 10.0 ** R.choice([0, 4, 9, 30, 300]) for _ in range(64)]) for i in range(40)]
    large = [(i, [float(round(x)) if abs(x) > 1e6 else x for x in v]) for i, v in large] + [(99, [2.0**21 - 0.25] * 64), (98, [-(2.0**21)] * 64)]
    sf = vectors(spark, large, tmp_path / "large", "double")
    assert multiset(registry.QUERIES["op11_weighted_clusters"](spark, sf), *CLUSTERED) == brute_clusters(large)


def test_clusters_of_nothing(spark, tmp_path):
    assert registry.QUERIES["op11_weighted_clusters"](spark, vectors(spark, [], tmp_path / "a")).columns == list(CLUSTERED)
    assert registry.QUERIES["op11_weighted_clusters"](spark, vectors(spark, [(1, None)], tmp_path / "b")).count() == 0


# Jaccard regions


def shingles(t, k=3):
    w = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return {b" ".join(w)} if 0 < len(w) < k else {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, share=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def documents(spark, rows, tmp_path):
    spark.createDataFrame([(d, t, "n", 1, b"k") for d, t in rows], "doc_id long, text string, node string, n int, key binary").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def edited(words, edits, pool):
    w = list(words)
    for _ in range(edits):
        w[R.randrange(len(w))] = R.choice(pool)
    return w


def cluster_texts():
    """Unrelated texts, copies, short texts, versions of versions, and a dense group whose members are near some of each other only."""
    pool = [f"w{i}" for i in range(4000)]
    rows, n = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (None, "only null"), (7, "a a a a a"), (8, "a a a")], 10
    for size in (9, 10, 11, 12, 20, 60, 200, 700):
        for _ in range(3):
            base = R.choices(pool, k=size)
            for edits in (0, 0, 1, 1, 2, max(1, size // 60), max(1, size // 40)):
                rows.append((n := n + 1, " ".join(edited(base, edits, pool))))
            rows.append((n := n + 1, " ".join(base + R.choices(pool, k=max(1, size // 12)))))
    base = R.choices(pool, k=150)
    for _ in range(90):  # far from each other, near the first at most
        rows.append((n := n + 1, " ".join(edited(base, R.randint(1, 12), pool))))
    for _ in range(4):  # groups that share edits
        child = edited(base, 8, pool)
        for _ in range(12):
            rows.append((n := n + 1, " ".join(edited(child, R.randint(0, 5), pool))))
    line = " ".join(R.choices(pool, k=20))
    for _ in range(60):  # a passage that unlike texts share
        rows.append((n := n + 1, " ".join(R.choices(pool, k=R.randint(3, 40))) + "\n" + line.upper()))
    return rows + [(70_000, " ".join(R.choices(pool, k=20_000)))] + rows[30:34]


def test_jaccard_components_equal_brute_force_and_sql(spark, tmp_path):
    rows = cluster_texts()
    sf = documents(spark, rows, tmp_path)
    got = multiset(registry.QUERIES["op12_jaccard_regions"](spark, sf), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows)
    assert of_sql(registry.SQL["op12_jaccard_regions"], documents=f"{sf}/documents.parquet") == (["doc_id", "n_shingles", "component_id"], got)


@pytest.mark.parametrize("share", [80])
def test_jaccard_components_at_wider_radius(spark, share):
    """Regions are cut more than once where many are near one another, but not near enough."""
    rows = cluster_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = multiset(jaccard.jaccard_components(docs, share=share), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows, share)


def test_members_with_too_many_edits_leave_before_all_differences_are_rows(spark, monkeypatch):
    """Edits of one text that no other has: most members of a region go by what the pivot hasn't, and near ones among them stay (F: op12)."""
    r, rows = random.Random(11), Counter()
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]

    def edited(words, n):
        return [f"e{r.randrange(10**6)}" if i in at else w for at in [set(r.sample(range(len(words)), n))] for i, w in enumerate(words)]

    texts = [base, *[edited(base, 20) for _ in range(40)]]
    texts += [edited(x, 2) for x in texts[1:6]]
    kept = jaccard.stored

    def counting(df, name, **options):
        out = kept(df, name, **options)
        if name in ("opened", "added", "differences"):
            rows[name] += out.agg(F.sum("d")).first()[0] or 0 if name == "opened" else out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", counting)
    monkeypatch.setattr(jaccard, "FEW", 2)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    found = {x.doc_id: x.component_id for x in jaccard.jaccard_components(docs).collect()}
    assert found == {i: i - 40 if i > 40 else i for i in range(len(texts))}
    assert rows["opened"] > 2000 and rows["added"] <= 0.7 * rows["opened"] and rows["differences"] <= 0.5 * rows["opened"]


def test_near_sets_agree_in_a_cell():
    r = np.random.default_rng(2)
    for size in (2, 8, 9, 10, 11, 19, 20, 40, 133, 1500):
        for _ in range(60):
            x = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            lost = int(r.integers(0, max(1, size // 9 + 1)))
            y = np.unique(np.concatenate([x[r.permutation(len(x))[lost:]], r.integers(0, 1 << 63, int(r.integers(0, size // 9 + 1))).astype(np.uint64)]))
            both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if 100 * both >= 90 * union and len(np.setxor1d(x, y)):
                assert set(jaccard.block_cells(x, 90).tolist()) & set(jaccard.block_cells(y, 90).tolist()), (size, both, union)


# prefix tries

NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[:2], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()))] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    out = Counter()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = lambda q: sum(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)
        ends = ",".join(str(c) for c in m if len(rebuilt[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out[m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids(p), sum(not kids(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def talks():
    say = lambda: R.choice(["hi", "yes", "no", "größe 😀", "", "a longer turn than the others"])
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 215), 300, -7, -100]:
        for t in range(R.randint(1, 7)):
            rows.append((c, t, R.choice(["user", "assistant"]), say()))
    rows += [(400 + i, t, "system" if t == 0 else "user", "same" if t < 4 else say()) for i in range(25) for t in range(R.randint(1, 6))]
    rows += [(500, None, None, "first"), (500, None, None, "first"), (500, 3, "user", None), (500, 3, "user", "tie"), (501, 0, None, None), (None, 0, "user", "lost"), (600, 0, "user", "x" * 50_000)]
    return rows + [(700, t, "user", str(t % 3)) for t in range(600)]


def spoken(spark, rows, tmp_path):
    spark.createDataFrame([(*r, i, "d") for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, depth int, cut string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_trie_equals_brute_force_and_sql(spark, tmp_path):
    rows = [r for r in talks() if r[0] is None or r[0] < 700]
    sf = spoken(spark, rows, tmp_path)
    want = brute_trie(rows)
    got = multiset(registry.QUERIES["op13_prefix_trie"](spark, sf), *NODES)
    assert got == want
    assert of_sql(registry.SQL["op13_prefix_trie"], conversations=f"{sf}/conversations.parquet") == (list(NODES), want)


def test_trie_cut_by_next_turns_and_dealt_to_small_buckets(spark):
    rows = talks()
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = multiset(trie.conversation_trie(docs), *NODES)
    assert multiset(trie.conversation_trie(docs, most=40, bucket=16), *NODES) == plain
    rows = [r for r in rows if r[0] is None or r[0] < 700]
    few = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert multiset(trie.conversation_trie(few, most=1, bucket=8), *NODES) == brute_trie(rows)


def test_ids_of_a_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 20)
    rows = [(i * 100, 0, "user", "same") for i in range(300)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert multiset(trie.conversation_trie(docs), *NODES) == brute_trie(rows)


def test_trie_of_nothing_and_of_conversations_without_turns(spark, tmp_path):
    assert registry.QUERIES["op13_prefix_trie"](spark, spoken(spark, [], tmp_path / "a")).count() == 0
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 5)]  # no conversation 0
    assert multiset(registry.QUERIES["op13_prefix_trie"](spark, spoken(spark, rows, tmp_path / "b")), *NODES) == brute_trie(rows)

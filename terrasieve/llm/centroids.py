"""Lloyd's clustering over distinct quantised vectors, each with its multiplicity.

Vectors become integers, floor(1024 * x), and equal ones are grouped by their digest
before anything else, so that copies cost nothing in the rounds. A round is one pass over
the distinct vectors: each task adds up its vectors times their multiplicities by
cluster, and what tasks return is added up by cluster and limb on the executors, so the driver gets
eight sums, however many vectors there are. Sums are exact integers of any size.
Labels are joined back to vec_ids by digest; both sides of the join have an exchange, so
that a vector with very many copies can be split.

Integers beyond ``SMALL`` are rare and counted as Python's, all others as 64-bit floats
in which every step is exact.

Defined results: rows whose vector is null, has another number of components or one that
is null or not finite are left out; ties in distance go to the smaller cluster; the first
centroids are by hash of vec_id, then by the vector's digest where ids repeat, null ids last; with fewer
vectors than clusters each is a centroid; repeated rows count each; an empty table gives no rows; distances
and inertias over the largest long are given as that; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, stored, table

K, ROUNDS, WIDTH, SCALE = 8, 10, 64, 1024

#: Up to here squares of differences of 64 components add up exactly in a double.
SMALL = 1 << 22

#: Sums travel in limbs of 27 decimal digits.
LIMB = 10**27

LONG = (1 << 63) - 1


def quantised(batches: Iterator[pa.RecordBatch], width: int = WIDTH) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, k, v): v has the components' floors, as 32-bit integers or else as text after a mark."""
    for batch in batches:
        lists = batch.column("embedding")
        fits = np.array([x is not None and x == width for x in pc.list_value_length(lists).to_pylist()], bool)
        batch = batch.filter(pa.array(fits))
        flat = batch.column("embedding").flatten().cast(pa.float64())
        x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
        whole = np.isfinite(x).all(axis=1)
        x, ids = x[whole], batch.column("vec_id").filter(pa.array(whole))
        with np.errstate(over="ignore"):
            y = np.floor(x * SCALE)
        near = (np.abs(y) < 1 << 31).all(axis=1)
        rows = y[near].astype("<i4")
        v: list[bytes] = [b""] * len(x)
        for i, row in zip(np.flatnonzero(near).tolist(), rows):
            v[i] = row.tobytes()
        for i in np.flatnonzero(~near).tolist():  # by fractions, as 1024 * x may be beyond a double
            v[i] = b"t" + ",".join(str(a * SCALE // b) for a, b in (z.as_integer_ratio() for z in x[i].tolist())).encode()
        k = [hashlib.sha256(b).digest() for b in v]
        yield pa.RecordBatch.from_arrays([ids, pa.array(k, pa.binary()), pa.array(v, pa.binary())], ["vec_id", "k", "v"])


def numbers(v: bytes) -> list[int]:
    return [int(x) for x in v[1:].split(b",")] if v[:1] == b"t" and len(v) != 4 * WIDTH else np.frombuffer(v, "<i4").tolist()


def read_vectors(column: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles, or of Python integers if any is beyond ``SMALL``."""
    raw = column.to_pylist()
    if all(len(b) == 4 * WIDTH for b in raw):
        x = np.frombuffer(b"".join(raw), "<i4").reshape(-1, WIDTH)
        if not x.size or max(-int(x.min()), int(x.max())) <= SMALL:
            return x.astype(np.float64)
    return np.array([numbers(b) for b in raw], dtype=object).reshape(-1, WIDTH)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row, the smaller one of ties, and the exact squared distance."""
    if x.dtype != object and max(abs(a) for c in centroids for a in c) <= SMALL:
        c = np.array(centroids, np.float64)
        far = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    else:
        x = x.astype(np.int64).astype(object) if x.dtype != object else x
        far = np.stack([((x - np.array(row, dtype=object)) ** 2).sum(axis=1) for row in centroids], axis=1)
    label = far.argmin(axis=1)
    return label, far[np.arange(len(x)), label]


def task_sums(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """(v, n) to one row a cluster and limb of the task: the sum of n and the weighted sums of all components."""
    count, total = [0] * len(centroids), [[0] * WIDTH for _ in centroids]
    for batch in batches:
        if not batch.num_rows:
            continue
        x, n = read_vectors(batch.column("v")), batch.column("n").to_numpy()
        label, _ = nearest(x, centroids)
        small = x.dtype != object and int(n.sum()) * SMALL < 1 << 62
        for j in np.unique(label).tolist():
            of = label == j
            w = n[of] if small else n[of].astype(object)
            rows = x[of].astype(np.int64) if x.dtype != object else x[of]
            count[j] += int(w.sum())
            total[j] = [a + int(b) for a, b in zip(total[j], (rows * w[:, None]).sum(axis=0))]
    out: list[tuple] = []
    for j, (n, row) in enumerate(zip(count, total)):
        limb = 0
        while n or any(row):
            low = [abs(a) % LIMB * (1 if a > 0 else -1) for a in row]
            out.append((j, limb, n, [str(a) for a in low]))
            row, n, limb = [(a - b) // LIMB for a, b in zip(row, low)], 0, limb + 1
    if out:
        j, limb, n, sums = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(limb, pa.int32()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.string()))], ["cluster", "limb", "n", "sums"])


def labelled(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """(k, v, n) to (k, n, cluster, distance)."""
    for batch in batches:
        label, far = nearest(read_vectors(batch.column("v")), centroids) if batch.num_rows else (np.zeros(0, int), [])
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n"), pa.array(label, pa.int32()), pa.array([min(int(d), LONG) for d in far], pa.int64())], ["k", "n", "cluster", "distance"])


def moved(distinct: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid with members at the floor of its members' mean; the others where they were."""
    parts = distinct.select("v", "n").mapInArrow(lambda it: task_sums(it, centroids), "cluster int, limb int, n long, sums array<string>")
    each = [F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(WIDTH)]
    found = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*each).alias("sums")).collect()  # some rows, as there are centroids
    count, total = [0] * len(centroids), [[0] * WIDTH for _ in centroids]
    for r in found:
        count[r.cluster] += r.n
        total[r.cluster] = [a + int(b) * LIMB**r.limb for a, b in zip(total[r.cluster], r.sums)]
    return [[a // n for a in row] if n else old for n, row, old in zip(count, total, centroids)]


def cluster(vectors: DataFrame, *, k: int = K, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = stored(vectors.mapInArrow(quantised, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, k binary, v binary"), "quantised")
    distinct = stored(rows.groupBy("k").agg(F.first("v").alias("v"), F.count("*").alias("n")), "distinct-vectors")
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    centroids = [numbers(bytes(r.v)) for r in rows.orderBy(by.asc_nulls_last(), "k").limit(k).collect()]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        after = moved(distinct, centroids)
        if after == centroids:
            break  # the rounds left would change nothing
        centroids = after
    labels = stored(distinct.mapInArrow(lambda it: labelled(it, centroids), "k binary, n long, cluster int, distance long"), "labels")
    weighted = F.sum(F.col("distance").cast("decimal(19,0)") * F.col("n"))
    inertia = {r.cluster: int(r.s) for r in labels.groupBy("cluster").agg(weighted.alias("s")).collect()}
    at = F.col("cluster") + 1
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each = [min(inertia.get(j, 0), LONG) for j in range(len(centroids))]
    return rows.select("vec_id", "k").join(labels.select("k", "cluster", "distance"), "k").select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(F.array(*[F.lit(x).cast("long") for x in each]), at).alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), LONG)).cast("long").alias("inertia"),
        F.element_at(F.array(*[F.lit(x) for x in digests]), at).alias("centroid_sha256"),
    )


def op11_weighted_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def _sql() -> str:
    """Ten rounds written out: an assignment and a move each."""
    near = "arg_min(c.cluster, {'d': list_sum(list_transform(list_zip(q, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'j': c.cluster})"
    parts = [
        "q AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, q AS c FROM (SELECT sha256('3:' || vec_id) AS h, q FROM q ORDER BY 1 LIMIT 8))",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT i, {near} AS cluster FROM q, c{r} c GROUP BY i)")
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT cluster, p, sum(v) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS v, unnest(range(64)) AS p FROM q JOIN a{r} USING (i)) GROUP BY 1, 2)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m, c) AS c FROM c{r} c LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS m FROM s{r} GROUP BY 1) USING (cluster))")
    parts.append(f"d AS (SELECT q.vec_id, cluster, CAST(list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance, c FROM q JOIN a{ROUNDS} USING (i) JOIN c{ROUNDS} USING (cluster))")
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM d"


OP11_SQL = _sql()

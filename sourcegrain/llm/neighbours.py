"""Approximate nearest neighbours over learned partitions.

On a bounded sample the exact neighbour graph is cut into balanced parts by recursive bisection; a small classifier
learns which part a vector belongs to. Every row is indexed under its most probable part; a query looks at its most
probable parts and ranks their rows by the exact measure.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.session import stored

SAMPLE = 8192  # vectors at most that the partition is learned from, chosen by a hash of the id
PARTS, PROBES, GRAPH = 16, 12, 12
BLOCK = 8192  # rows of one part that a task compares at once


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(unit), k), np.int64)
    for at in range(0, len(unit), 1024):
        near = unit[at:at + 1024] @ unit.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at:at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Part of each node: halves of equal size, again and again, along the slowest wave of the graph inside the half."""
    rng = np.random.default_rng(seed)
    label = np.zeros(len(graph), np.int64)
    for _ in range(int(np.log2(parts))):
        wave = rng.standard_normal(len(graph))
        same = label[graph] == label[:, None]
        degree = same.sum(axis=1) + 1
        count = np.bincount(label)
        for _ in range(60):
            wave = (wave + (wave[graph] * same).sum(axis=1)) / degree
            wave -= (np.bincount(label, wave) / count)[label]
            wave /= np.sqrt(np.bincount(label, wave * wave) / count)[label] + 1e-12
        half = np.zeros(len(graph), np.int64)
        for p in range(label.max() + 1):
            own = np.flatnonzero(label == p)
            half[own[np.argsort(wave[own], kind="stable")[len(own) // 2:]]] = 1
        label = 2 * label + half
    return label


def classifier(unit: np.ndarray, label: np.ndarray, parts: int, steps: int = 300) -> np.ndarray:
    """Softmax regression; weights of (dimensions and a constant) by parts."""
    x = np.hstack([unit, np.ones((len(unit), 1))])
    w, m, v = (np.zeros((x.shape[1], parts)) for _ in range(3))
    goal = np.eye(parts)[label]
    for step in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        grad = x.T @ (p / p.sum(axis=1, keepdims=True) - goal) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of two matrices, in double precision; a pair gives the same value wherever it stands."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def fit(vectors: np.ndarray) -> np.ndarray | None:
    """The classifier's weights; None where the sample is too small to be cut."""
    if len(vectors) < 64 * PARTS:
        return None
    unit = _unit(vectors)
    return classifier(unit, balanced_parts(neighbour_graph(unit, GRAPH), PARTS), PARTS)


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose id is divisible by ``every``.

    Vectors that are null, empty, zero or hold null or non-finite components, or whose id is null, take no part; nor do
    vectors of another length than the most common one. Of equal vectors the k + 1 smallest ids are candidates, the
    others can't rank. Repeated rows count once. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = stored(raw.where(F.col("id").isNotNull() & sound).withColumn("d", F.size("v")))
    common = rows.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.col("d") == (common["d"] if common else 0))
    queries = rows.where(F.col("id") % every == 0).select("id", "v").distinct()
    equal = Window.partitionBy("v").orderBy("id")
    candidates = rows.withColumn("n", F.dense_rank().over(equal)).where(F.col("n") <= k + 1).select("id", "v").distinct()
    candidates = stored(candidates)
    sample = candidates.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    weights = fit(np.array([r["v"] for r in sample])) if sample else None

    def route(probes: int):
        def run(batches):
            for b in batches:
                x = _matrix(b.column(1)) if b.num_rows else np.zeros((0, 1))
                if weights is None:
                    order = np.zeros((len(x), 1), np.int32)
                else:
                    z = np.hstack([_unit(x), np.ones((len(x), 1))]) @ weights
                    order = np.argsort(-z, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield b.append_column("parts", pa.array(list(order), pa.list_(pa.int32())))
        return run

    routed = "id long, v array<double>, parts array<int>"
    indexed = stored(candidates.mapInArrow(route(1), routed).withColumn("part", F.col("parts")[0]).drop("parts"))
    sizes = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}  # at most PARTS rows
    blocks = {p: max(1, -(-n // BLOCK)) for p, n in sizes.items()}
    block_of = F.create_map(*[F.lit(x) for p, b in sorted(blocks.items()) for x in (p, b)]) if blocks else F.create_map(F.lit(0), F.lit(1))
    probes = PROBES if min(sizes.values(), default=0) > k and len(sizes) >= PROBES else PARTS  # small parts: look at all
    left = indexed.withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce(block_of[F.col("part")], F.lit(1))).cast("int"))
    asked = queries.mapInArrow(route(probes), routed).select("id", "v", F.explode("parts").alias("part"))
    right = asked.select("id", "v", "part", F.explode(F.sequence(F.lit(0), F.coalesce(block_of[F.col("part")], F.lit(1)) - 1)).alias("block"))

    def rerank(index, query):
        ids, qids = index["id"].to_numpy(), query["id"].to_numpy()
        out_q, out_i, out_s = [], [], []
        if len(ids) and len(qids):
            x, q = _matrix(index["v"].combine_chunks()), _matrix(query["v"].combine_chunks())
            ux, uq = _unit(x), _unit(q)
            for at in range(0, len(q), 256):
                near = uq[at:at + 256] @ ux.T
                near[qids[at:at + 256][:, None] == ids[None, :]] = -np.inf
                kth = -np.partition(-near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
                i, j = np.nonzero((near >= kth[:, None] - 1e-9) & np.isfinite(near))
                out_q.append(qids[at:at + 256][i])
                out_i.append(ids[j])
                out_s.append(cosine(q[at:at + 256][i], x[j]))
        columns = [np.concatenate(c) if c else np.zeros(0, t) for c, t in ((out_q, np.int64), (out_i, np.int64), (out_s, np.float64))]
        return pa.table(dict(zip(["query_id", "vec_id", "score"], columns, strict=True)))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * sum(blocks.values()))
    found = (left.repartition(parts, "part", "block").groupBy("part", "block").cogroup(right.repartition(parts, "part", "block").groupBy("part", "block"))
             .applyInArrow(rerank, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

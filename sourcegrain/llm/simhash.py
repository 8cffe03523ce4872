"""SimHash near-dedup over a Gray-order hierarchical index.

Two fingerprints that differ in at most three of 64 bits agree in one of four 16-bit blocks and, in the other 48 bits,
in one of four 12-bit blocks. Each of these sixteen views puts the agreeing 28 bits first. The rows of all views are
sorted by Gray rank over range partitions, cut into leaves of bounded size, and searched top down: a node keeps the
bits that its fingerprints share, and a group leaves as soon as the differences on shared bits exceed the limit. Keys
that spread over several leaves meet leaf by leaf, again only where the shared bits allow it. Every leaf, and pair of
leaves, gives a spanning forest of its links, so a group of copies of any size gives no more links than members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcegrain.llm.common import mapped, utf8
from sourcegrain.operators.similarity import components
from sourcegrain.session import small_batches, stored

BITS, LEAF, NODE = 3, 1024, 32
KEY_BITS = 28


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 hashes (seed 42) of the 3-word shingles; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [b" ".join(words)]
    hashes = np.array([digest(s, 42) for s in joined], dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    def run(batches):
        for b in batches:
            values = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.int64())], ["id", "fp"])
    rows = docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text"))
    return rows.mapInArrow(mapped(run), T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())]))


def _views(fp: Column) -> Column:
    """All views of a fingerprint as (view, Gray rank)."""
    def up(x: Column, n: int) -> Column:
        return F.shiftleft(x, n) if n else x

    low48, views = (1 << 48) - 1, []
    for a in range(4):
        turned = up(fp, 16 * a).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * a)) if a else fp
        head, tail = turned.bitwiseAND(F.lit(-1 << 48)), turned.bitwiseAND(F.lit(low48))
        for b in range(4):
            t = up(tail, 12 * b).bitwiseOR(F.shiftrightunsigned(tail, 48 - 12 * b)).bitwiseAND(F.lit(low48)) if b else tail
            views.append(F.struct(F.lit(4 * a + b).alias("view"), head.bitwiseOR(t).alias("bits")))
    return F.array(*views)


def _rank(bits: Column) -> Column:
    """Place of the bits in reflected Gray order, shifted so that signed order is the unsigned one."""
    for by in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, by))
    return bits.bitwiseXOR(F.lit(-1 << 63))


def _node(values: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """(mask of the bits all values share, these bits)."""
    every = np.bitwise_and.reduce(values)
    mask = ~(np.bitwise_or.reduce(values) ^ every)
    return mask, every & mask


def near(queries: np.ndarray, leaf: np.ndarray, limit: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (query, leaf member) of all within ``limit`` bits; groups of the leaf are dropped by their shared bits."""
    left, right = [], []
    nodes = [_node(leaf[s:s + NODE]) for s in range(0, len(leaf), NODE)]
    for n, (mask, bits) in enumerate(nodes):
        q = np.flatnonzero(np.bitwise_count((queries ^ bits) & mask) <= limit)
        if len(q):
            hit = np.bitwise_count(queries[q][:, None] ^ leaf[None, n * NODE:(n + 1) * NODE]) <= limit
            i, j = np.nonzero(hit)
            left.append(q[i])
            right.append(j + n * NODE)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _forest(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each value to the smallest-numbered one that the pairs (a, b) reach."""
    label = np.arange(len(values))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(values)))
    return values[own], values[label[own]]


def _original(view: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The fingerprint behind the bits of a view."""
    a, b = (view // 4).astype(np.uint64), (view % 4).astype(np.uint64)
    low48 = np.uint64((1 << 48) - 1)
    tail, by = bits & low48, np.uint64(12) * b
    tail = np.where(b > 0, (tail >> by) | ((tail << (np.uint64(48) - by)) & low48), tail)
    turned, by = (bits & ~low48) | tail, np.uint64(16) * a
    return np.where(a > 0, (turned >> by) | (turned << ((np.uint64(64) - by) % np.uint64(64))), turned)


_OUT = "src long, dst long, key long, leaf string, shared long, bits long, fps binary"


def _batch(src=(), dst=(), key=(), leaf=(), shared=(), bits=(), fps=()) -> pa.RecordBatch:
    n = max(len(src), len(key))
    def longs(x):
        return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64)) if len(x) else pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [longs(src), longs(dst), longs(key), pa.array(leaf, pa.string()) if len(key) else pa.nulls(n, pa.string()), longs(shared), longs(bits),
         pa.array(fps, pa.binary()) if len(key) else pa.nulls(n, pa.binary())], ["src", "dst", "key", "leaf", "shared", "bits", "fps"])


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of Gray ranks: links inside leaves, and the leaves whose key goes on in another one."""
    views, ranks = [], []
    for b in batches:
        views.append(b.column(0).to_numpy())
        ranks.append(b.column(1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63))
    if not views:
        return
    view, rank = np.concatenate(views), np.concatenate(ranks)
    order = np.lexsort((rank, view))
    view, rank = view[order], rank[order]
    bits = rank ^ (rank >> np.uint64(1))
    fp = _original(view, bits)
    key = (view.astype(np.uint64) << np.uint64(KEY_BITS)) | (bits >> np.uint64(64 - KEY_BITS))
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    sizes = np.diff(starts)
    edge = {0, len(sizes) - 1}
    src, dst, nodes = [], [], []
    for run in sorted(set(np.flatnonzero(sizes > 1).tolist()) | edge):
        s, e = starts[run], starts[run + 1]
        for at in range(s, e, LEAF):
            leaf = fp[at:min(at + LEAF, e)]
            u, v = _forest(leaf, *near(leaf, leaf))
            src.append(u)
            dst.append(v)
            if e - s > LEAF or run in edge:
                nodes.append((key[s], f"{rank[at]:016x}-{view[at]}", *_node(leaf), leaf.tobytes()))
    if sum(map(len, src)):
        yield _batch(np.concatenate(src), np.concatenate(dst))
    for at in range(0, len(nodes), 1000):
        k, leaf, shared, b, fps = zip(*nodes[at:at + 1000], strict=True)
        yield _batch(key=k, leaf=leaf, shared=shared, bits=b, fps=fps)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        src, dst = [], []
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            i, j = near(one, two)
            u, v = _forest(np.concatenate([one, two]), i, j + len(one))
            src.append(u.view(np.int64))
            dst.append(v.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src) if src else [], pa.int64()),
                                          pa.array(np.concatenate(dst) if dst else [], pa.int64())], ["src", "dst"])


def links(distinct: DataFrame) -> DataFrame:
    """Links (src, dst) that connect all fingerprints ``fp`` within three bits; ``distinct`` must be cheap to read twice."""
    spark = distinct.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), distinct.count() // 60_000 + 1)
    rows = distinct.select(F.explode(_views(F.col("fp"))).alias("v")).select("v.view", _rank(F.col("v.bits")).alias("rank"))
    found = stored(rows.repartitionByRange(parts, "view", "rank").mapInArrow(_leaves, _OUT))
    nodes = found.where("key is not null")
    heads = nodes.select("key", "leaf", "shared", "bits")
    other = heads.select("key", F.col("leaf").alias("leaf2"), F.col("shared").alias("shared2"), F.col("bits").alias("bits2"))
    apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("bits2")).bitwiseAND(F.col("shared")).bitwiseAND(F.col("shared2")))
    pairs = heads.join(other, "key").where("leaf < leaf2").where(apart <= BITS).select("key", "leaf", "leaf2")
    fetched = (pairs.join(nodes.select("key", "leaf", F.col("fps").alias("x")), ["key", "leaf"])
               .join(nodes.select("key", F.col("leaf").alias("leaf2"), F.col("fps").alias("y")), ["key", "leaf2"]))
    across = fetched.select("x", "y").mapInArrow(_across, "src long, dst long")
    return found.where("src is not null").select("src", "dst").union(across).distinct()


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp, component): each document's fingerprint and the smallest id its links reach, itself included.

    Null texts count as empty (fingerprint zero); rows without id keep a null component unless they share a fingerprint
    with others; repeated rows give repeated results; an empty table gives no rows. No text leaves its task.
    """
    with small_batches(docs.sparkSession):
        prints = stored(fingerprints(docs, id_column, text_column))
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("first")))
    joined = links(distinct.select("fp"))
    edges = stored(joined)
    touched = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    label = components(touched, edges).select(F.col("node").alias("fp"), F.col("component").alias("label"))
    labelled = distinct.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component"))
    named = labelled.join(smallest, "label").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group: the one of the smallest id, of several texts with that id the one of the smallest digest,
    of rows that repeat id and text one. An id whose texts lie in several groups can so stay once for each. Rows without
    id link others but all stay. Columns are those of ``docs``; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    keyed = docs.select(F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"), digest.alias("digest")).alias("key"), text.alias("text"))
    firsts = groups(keyed, "key", "text").where("id = component and not id.no_id").select(F.col("id.id").alias("_first_id"), F.col("id.digest").alias("_first_digest")).distinct()
    same = (docs[id_column] == F.col("_first_id")) & (F.col("_own_digest") == F.col("_first_digest"))
    kept = docs.withColumn("_own_digest", digest).join(firsts, same, "left_semi").dropDuplicates([id_column, "_own_digest"]).drop("_own_digest")
    return kept.unionByName(docs.where(F.col(id_column).isNull()))

"""Substring dedup with difference-cover anchors.

Anchors are hashes of ``window - period + 1`` words at places whose number modulo ``period`` lies in a difference
cover. For any two places there is a shift below the period that brings both onto the cover, so two equal windows
share an anchor at the same shift. Only windows over an anchor that occurs twice are then hashed whole (the match is
extended to its full length) and compared. Both rounds send each distinct hash once per chunk of documents, so a
passage that a third of all documents hold is one entry per chunk and no pairs are listed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcegrain.llm.common import BASE_HIGH, BASE_LOW, Words, by_bucket, give_back, in_chunks, rolling, utf8

PERIOD, COVER = 21, (0, 1, 4, 14, 16)  # a perfect difference set: every shift below 21 is a difference once

_SENT = "_bucket int, _chunk int, _high binary, _low binary, _twice binary"
_BACK = "_chunk int, _round int, _bucket int, _bits binary"


class _Chunk:
    """The windows of one chunk; the same for any order of its documents."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, width = window, window - PERIOD + 1
        self.words = w = Words(texts)
        self.whole = w.left >= window
        here = np.isin(w.place % PERIOD, COVER) & (w.left >= width) & (w.place + w.left >= window)
        self.anchors = np.flatnonzero(here)
        self.anchor_hash = rolling(w.high, width, BASE_HIGH)[self.anchors]

    def first_round(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, counts = np.unique(self.anchor_hash, return_counts=True)
        return keys, np.zeros(0, np.uint64), counts > 1

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows over a repeated anchor; ``repeated`` goes with the sorted distinct anchors."""
        keys = np.unique(self.anchor_hash)
        marks = np.zeros(len(self.whole) + 1, np.int32)
        marks[self.anchors + 1] = repeated[np.searchsorted(keys, self.anchor_hash)]
        total = np.cumsum(marks, dtype=np.int32)
        starts = np.flatnonzero(self.whole)
        return starts[total[np.minimum(starts + PERIOD, len(self.whole))] > total[starts]]

    def second_round(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct (high, low) of the candidates, whether each stands twice here, and each start's number."""
        high = rolling(self.words.high, self.window, BASE_HIGH)[starts]
        low = rolling(self.words.low, self.window, BASE_LOW)[starts]
        order = np.lexsort((low, high))
        h, l = high[order], low[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        twice = np.bincount(number, minlength=int(new.sum())) > 1
        return h[new], l[new], twice, number

    def removed(self, starts: np.ndarray) -> np.ndarray:
        cover = np.zeros(len(self.whole) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.subtract.at(cover, starts + self.window, 1)
        return np.cumsum(cover[:-1]) > 0


def _send(chunk: int, high: np.ndarray, low: np.ndarray, twice: np.ndarray, buckets: int) -> pa.Table:
    edges = by_bucket(high, buckets)
    rows = [(b, s, e) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]
    return pa.table({"_bucket": pa.array([b for b, _, _ in rows], pa.int32()),
                     "_chunk": pa.array([chunk] * len(rows), pa.int32()),
                     "_high": pa.array([high[s:e].tobytes() for _, s, e in rows], pa.binary()),
                     "_low": pa.array([low[s:e].tobytes() for _, s, e in rows], pa.binary()),
                     "_twice": pa.array([np.packbits(twice[s:e]).tobytes() for _, s, e in rows], pa.binary())})


def _compare(round_: int):
    """Of each message the bits that tell which of its hashes occur elsewhere or twice."""
    def compare(table):
        rows = table.to_pylist()
        highs = [np.frombuffer(r["_high"], np.uint64) for r in rows]
        high = np.concatenate(highs)
        sizes = [len(h) for h in highs]
        low = np.concatenate([np.frombuffer(r["_low"], np.uint64) for r in rows])
        low = low if len(low) else np.zeros(len(high), np.uint64)
        weight = 1 + np.concatenate([np.unpackbits(np.frombuffer(r["_twice"], np.uint8), count=n)
                                     for r, n in zip(rows, sizes, strict=True)]).astype(np.int64)
        order = np.lexsort((low, high)) if low.any() else np.argsort(high)
        h, l = high[order], low[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=weight[order])
        repeated = np.empty(len(h), bool)
        repeated[order] = total[group] > 1
        parts = np.split(repeated, np.cumsum(sizes)[:-1])
        return pa.table({"_chunk": table["_chunk"].combine_chunks().cast(pa.int32()),
                         "_round": pa.array([round_] * len(rows), pa.int32()),
                         "_bucket": table["_bucket"].combine_chunks().cast(pa.int32()),
                         "_bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})
    return compare


def _answers(back: pa.Table, round_: int, sorted_high: np.ndarray, buckets: int) -> np.ndarray:
    edges, out = by_bucket(sorted_high, buckets), np.zeros(len(sorted_high), bool)
    for r in back.to_pylist():
        if r["_round"] == round_:
            s, e = edges[r["_bucket"]], edges[r["_bucket"] + 1]
            out[s:e] = np.unpackbits(np.frombuffer(r["_bits"], np.uint8), count=int(e - s)).astype(bool)
    return out


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 35) -> DataFrame:
    """Each document without the words of any ``window`` consecutive words that also start elsewhere.

    Returns the input's columns as a struct ``doc`` plus ``n_words``, ``n_removed`` (long), ``kept_text`` (the text
    itself where nothing is removed, else the kept words joined by one space) and ``kept_sha256`` (of the joined words).
    Windows are judged on the input; null texts have no words; a repeated row counts as another document; a document
    below ``window`` words keeps all; an empty table gives no rows. Other columns of any name stay inside ``doc``.
    A text is held whole by one task, with about 60 bytes a word beside it.
    """
    if window < PERIOD + 2:
        raise ValueError(f"windows of at least {PERIOD + 2} words are needed")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    packed = packed.select("doc", F.col(f"doc.`{id_column}`").alias("_id"), F.col(f"doc.`{text_column}`").alias("_t"))
    dealt, buckets = in_chunks(packed, "_id", "_t")
    dealt = dealt.withColumn("_text", utf8("_t")).select("_chunk", "_text", "doc")

    def chunk(table: pa.Table) -> _Chunk:
        give_back()  # of the group before
        return _Chunk(table["_text"].to_pylist(), window)

    def ask_anchors(key, table):
        return _send(key[0].as_py(), *chunk(table).first_round(), buckets)

    def ask_windows(key, table, back):
        c = chunk(table)
        high, low, twice, _ = c.second_round(c.candidates(_answers(back, 1, np.unique(c.anchor_hash), buckets)))
        return _send(key[0].as_py(), high, low, twice, buckets)

    def finish(key, table, back):
        give_back()
        texts = table["_text"].to_pylist()
        c = _Chunk(texts, window)
        starts = c.candidates(_answers(back, 1, np.unique(c.anchor_hash), buckets))
        high, _, _, number = c.second_round(starts)
        gone = c.removed(starts[_answers(back, 2, high, buckets)[number]])
        n_words, n_removed, kept_text, digests = [], [], [], []
        distinct = c.words.distinct
        for number, text in enumerate(texts):
            words, mask = c.words.of(number), gone[c.words.starts[number]:c.words.starts[number + 1]]
            lost = int(mask.sum())
            kept = b" ".join([distinct[i] for i in (words[~mask] if lost else words).tolist()])
            n_words.append(len(words))
            n_removed.append(lost)
            kept_text.append(kept if lost else text)
            digests.append(hashlib.sha256(kept).hexdigest())
        return pa.table({"doc": table["doc"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                         "kept_text": pa.array(kept_text, pa.binary()), "kept_sha256": pa.array(digests, pa.string())})

    asked = dealt.groupBy("_chunk").applyInArrow(ask_anchors, _SENT)
    first = asked.repartition(buckets, "_bucket").groupBy("_bucket").applyInArrow(_compare(1), _BACK)
    again = dealt.groupBy("_chunk").cogroup(first.repartition(buckets, "_chunk").groupBy("_chunk")).applyInArrow(ask_windows, _SENT)
    second = again.repartition(buckets, "_bucket").groupBy("_bucket").applyInArrow(_compare(2), _BACK)
    both = first.union(second).repartition(buckets, "_chunk")
    out = T.StructType([dealt.schema["doc"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                        T.StructField("kept_text", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])
    kept = dealt.groupBy("_chunk").cogroup(both.groupBy("_chunk")).applyInArrow(finish, out)
    return kept.withColumn("kept_text", F.col("kept_text").cast("string"))

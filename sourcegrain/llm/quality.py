"""Quality classifier: Bradley-Terry scores from preference pairs.

Each pair of a better and a worse labelled document asks that the better one's score be higher: logistic loss on the
difference of their features. The threshold is the quantile of the training scores at the share of worse documents.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcegrain.functions.ranking import number_rows
from sourcegrain.llm.common import utf8
from sourcegrain.session import stored

PAIRS = 4  # pairs that each labelled document of the more frequent label is in
WIDTH = 16
CUT = 0.7
SPAN = 24  # words in one stretch of a text
_SYMBOLS = b"!#$%&*|<>{}[]=+~^@_\\/"
_DROP_SYMBOLS = bytes.maketrans(b"", b"")


def features(text: bytes) -> list[float]:
    """Shares and ratios of a text and of its worst and mean stretch; all zero for an empty text but the last."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 15 + [1.0]
    size = len(text)
    symbols = np.fromiter([len(w) - len(w.translate(_DROP_SYMBOLS, _SYMBOLS)) for w in words], np.float64, n)
    lengths = np.fromiter(map(len, words), np.float64, n)
    marked = symbols >= np.maximum(1, np.minimum(2, lengths / 2))
    shouted = np.fromiter([len(w) > 2 and w.isupper() for w in words], np.float64, n)
    again = np.zeros(n)
    again[1:] = [a == b for a, b in zip(words, words[1:], strict=False)]
    distinct = len(set(words)) / n
    odd = np.maximum(np.maximum(marked, shouted), again)
    edges = np.arange(0, n, SPAN)
    stretches = np.add.reduceat(odd, edges) / np.minimum(SPAN, n - edges)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated_lines = 1 - len(set(lines)) / len(lines)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [np.log1p(n), lengths.mean(), symbols.sum() / size, marked.mean(), shouted.mean(), again.mean(), distinct, distinct * np.log1p(n),
            stretches.max(), stretches.mean(), (stretches > 0.5).mean(), repeated_lines, max(counts.values()) / n,
            sum(b"0" <= w[:1] <= b"9" for w in words) / n, sum(w[-1:] in b".!?" for w in words) / n, 0.0]


def featured(docs: DataFrame, keep: list[str] | None = None, text_column: str = "text") -> DataFrame:
    """The columns ``keep`` (null: all) of each row as a struct ``doc`` plus ``features`` of its whole text.

    Only the texts reach Python, in slices, and only the features come back; ``doc`` stays in the JVM.
    """
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def made(text: pa.Array) -> pa.Array:
        rows = [features(t) for at in range(0, len(text), 256) for t in text.slice(at, 256).to_pylist()]
        return pa.array(rows, pa.list_(pa.float64()))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"), made(utf8(text_column)).alias("features"))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``CUT`` at the threshold."""
        shifted = np.clip(self.raw(x) - self.threshold, -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-shifted))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def _steady(values) -> np.ndarray:
    """Nine digits, so that the order in which tasks added up changes nothing."""
    return np.array([float(f"{v:.9g}") for v in values])


def _pairs(rows: DataFrame, larger: int, fewer: int) -> DataFrame:
    """(gap): better minus worse features. Each row of the larger class meets ``PAIRS`` of the other one, all of which are met."""
    numbered = number_rows(rows, [F.xxhash64("id"), F.col("id"), F.col("features")], "n", per="label", start=0)
    many = numbered.where(F.col("label") == larger).select("features", F.explode(F.array([F.pmod(F.col("n") + k * 7919, F.lit(fewer)) for k in range(PAIRS)])).alias("n"))
    few = numbered.where(F.col("label") != larger).select("n", F.col("features").alias("other"))
    sign = 1.0 if larger else -1.0
    return many.join(few, "n").select(F.zip_with("features", "other", lambda a, b: (a - b) * sign).alias("gap"))


def _loss(pairs: DataFrame, scale: np.ndarray, w: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over all pairs, its gradient and its second derivatives: sums of each task, added up by Spark."""
    def run(batches):
        total = np.zeros(2 + WIDTH + WIDTH * WIDTH)
        for b in batches:
            gap = _matrix(b.column(0)) / scale
            margin = gap @ w
            missed = 1 / (1 + np.exp(np.clip(margin, -50, 50)))
            total += np.concatenate([[len(gap), np.logaddexp(0, -margin).sum()], -(missed @ gap), ((gap.T * (missed * (1 - missed))) @ gap).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])
    sums = pairs.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    _, v = np.array(sorted((r["i"], r["v"]) for r in sums)).T
    v = v[1:] / v[0]
    return float(v[0] + ridge / 2 * w @ w), v[1:WIDTH + 1] + ridge * w, v[WIDTH + 1:].reshape(WIDTH, WIDTH) + ridge * np.eye(WIDTH)


def fit(rows: DataFrame, steps: int = 30, ridge: float = 1e-3) -> Model:
    """Bradley-Terry weights from (better, worse) pairs of all ``rows`` (id, features, label), by Newton's method. With one
    kind of label only, every score is at the cut or above for 1 and below for 0."""
    x = [F.col("features")[i] for i in range(WIDTH)]
    n, good, *moments = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    if good in (0, n):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), -1.0 if good or not n else 1.0)
    bad = n - good
    mean, scale = _steady(moments[:WIDTH]), _steady(moments[WIDTH:]) + 1e-6
    pairs = stored(_pairs(rows, int(good >= bad), min(good, bad)))
    w = np.zeros(WIDTH)
    loss, slope, bend = _loss(pairs, scale, w, ridge)
    for _ in range(steps):
        step = np.linalg.solve(bend, slope)
        if slope @ step < 1e-12:
            break
        while (found := _loss(pairs, scale, w - step, ridge))[0] > loss and slope @ step > 1e-12:
            step = step / 2
        w, (loss, slope, bend) = w - step, found
    model = Model(mean, scale, _steady(w), 0.0)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(b.column(0))))], ["raw"])
    raws = number_rows(rows.select("features").mapInArrow(run, "raw double"), [F.col("raw")], "n", start=0)
    low, high = raws.where(F.col("n").isin(bad - 1, bad)).agg(F.min("raw"), F.max("raw")).first()
    return replace(model, threshold=(low + high) / 2)


def held_out(id_column: str):
    """The rows that no label is learned from."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """Fit on all labelled rows outside the held-out part."""
    return train_featured(featured(docs, [id_column], text_column), labels, id_column, label_column)


def train_featured(rows: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality") -> Model:
    """Like ``train``, on rows whose features are known; only ids and features meet the labels."""
    marks = (labels.where(~held_out(id_column)).where(F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).alias("id"))
             .agg(F.min(label_column).cast("int").alias("label")))
    return fit(stored(rows.select(F.col(f"doc.{id_column}").alias("id"), "features").join(marks, "id").select("id", "features", "label")))


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The input's columns as a struct ``doc`` plus ``score`` (0 to 1). Null and empty texts are scored as an empty text;
    rows keep their number; an empty table gives no rows."""
    return score_featured(featured(docs, text_column=text_column), model)


def score_featured(rows: DataFrame, model: Model) -> DataFrame:
    """``doc`` and ``score`` of rows whose features are known; only the features reach Python."""
    @F.arrow_udf(T.DoubleType())
    def scored(x: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(x)), pa.float64())
    return rows.select("doc", scored("features").alias("score"))

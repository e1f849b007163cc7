"""Quality classifier: random Fourier features of document statistics, ridge, isotonic.

`statistics` turns each whole text into a few numbers. cos(Wx + b) of the
standardised numbers approximates a Gaussian kernel. Every partition sums Z'Z and
Z'y over its labelled rows; the sums are added up in Spark and the ridge system, of
fixed size, is solved on the driver. Isotonic regression over a fixed grid of raw
scores maps them to probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, carried, durable, hash_spans, map_text, share, slices, spans_of, utf8

STATISTICS = [
    "log_words", "mean_word", "log_longest_word", "upper_share", "digit_share", "symbol_share", "sentence_share",
    "symbol_end_share", "distinct_share", "repeat_share", "top_word_share", "short_word_share", "bar_share",
    "line_share", "repeated_line_share", "non_ascii_share", "shout_share",
]

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other ASCII symbol, 6 non-ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 5
_CLASS[[0x2C, 0x2E, 0x27, 0x22, 0x3A, 0x3B, 0x3F, 0x28, 0x29, 0x2D]] = 4
_CLASS[128:] = 6
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 13]] = True


def ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def runs_within(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document, and how often its commonest key occurs."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
    most = np.zeros(n)
    np.maximum.at(most, d[first], np.diff(np.append(first, len(d))))
    return np.bincount(d[first], minlength=n), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n = len(offsets) - 1
    kind = _CLASS[data]
    of = np.repeat(np.arange(n), np.diff(offsets))
    by = np.bincount(of * 8 + kind, minlength=n * 8).reshape(n, 8).astype(float)
    # Latin-1 capitals: C3 80 to C3 9E
    capital = np.zeros(len(data), dtype=bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = by[:, 2] + np.bincount(of[capital], minlength=n)
    size = np.diff(offsets).astype(float)
    start, end, doc = spans_of(data, offsets, SPACE)
    words = np.bincount(doc, minlength=n).astype(float)
    length = (end - start).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    key = hash_spans(data, start, end, LOWER)
    distinct, top = runs_within(doc, key, n)
    again = np.concatenate([[False], (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])]) if len(key) else np.zeros(0, bool)
    last, first = (kind[end - 1], kind[start]) if len(end) else (np.zeros(0, np.uint8),) * 2
    line_start, line_end, line_doc = spans_of(data, offsets, _BREAK)
    lines = np.bincount(line_doc, minlength=n).astype(float)
    distinct_lines, _ = runs_within(line_doc, hash_spans(data, line_start, line_end), n)
    letters = by[:, 1] + by[:, 2] + by[:, 6]
    count = lambda mask: np.bincount(doc[mask], minlength=n)
    return np.column_stack([
        np.log1p(words), ratio(length_sum := np.bincount(doc, weights=length, minlength=n), words), np.log1p(longest),
        ratio(upper, letters), ratio(by[:, 3], size), ratio(by[:, 5], size), ratio(by[:, 4], size),
        ratio(count(last == 5), words), ratio(distinct, words), ratio(count(again), words), ratio(top, words),
        ratio(count(length <= 3), words), ratio(count((length == 1) & (first == 5)), words),
        ratio(lines, words), 1 - ratio(distinct_lines, np.maximum(lines, 1)) * (lines > 0) - (lines == 0), ratio(by[:, 6], size),
        ratio(np.bincount(of[data == 0x21], minlength=n), np.maximum(words, length_sum / 50)),
    ])


#: Name of the column that `describe` adds and `score` takes away.
DESCRIBED = "quality_statistics"


def describe(docs: DataFrame, text_col: str = "text", keep=None) -> DataFrame:
    """docs with `quality_statistics`, an array of doubles; zeros where there is no text."""

    def run(column):
        data, offsets = utf8(column)
        rows = [statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
        flat = np.concatenate(rows).ravel() if rows else np.empty(0)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(flat, pa.float64()))]

    return map_text(docs, text_col, keep, [T.StructField(DESCRIBED, T.ArrayType(T.DoubleType()))], run)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, rising
    levels: np.ndarray  # calibrated scores at the knots

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions
        return np.column_stack([np.cos(z + self.phases) * np.sqrt(2 / len(self.phases)), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(STATISTICS))


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over rising x with means y of n rows; centres and
    levels of the blocks."""
    blocks: list[list[float]] = []  # sum of n*x, sum of n*y, n
    for a, b, c in zip(x, y, n, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


#: Raw scores are calibrated on a grid of this step between -1 and 2.
GRID = 0.001

#: Partition sums (half a megabyte each) that one task or the driver adds up.
MERGED = 32


def fit(described: DataFrame, labels: DataFrame, key: str = "doc_id", label_col: str = "quality", features: int = 256, ridge: float = 1e-3, width: float = 0.03, seed: int = 17) -> Model | None:
    """Fit on the rows of `described` that have a label 0 or 1. Of several labels of
    one key the largest counts. None if there is no labelled row."""
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(key).alias("__key")).agg(F.max(label_col).cast("double").alias("__y"))
    rows = durable(described.join(marks, F.col(key) == F.col("__key")).select(DESCRIBED, "__y"))
    k = len(STATISTICS)
    each = [F.get(DESCRIBED, F.lit(i)) for i in range(k)]
    summary = rows.agg(F.count("*"), *[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    if not summary[0]:
        return None
    mean, scale = np.array(summary[1 : k + 1], dtype=float), np.array(summary[k + 1 :], dtype=float)
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(k, features)) * np.sqrt(2 * width), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.0]))
    size = features + 1

    def sums(batches):
        zz, zy, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            x, y = matrix(batch.column(DESCRIBED)), batch.column("__y").to_numpy()
            for i in range(0, len(y), 4096):
                z = model.features(x[i : i + 4096])
                zz += z.T @ z
                zy += z.T @ y[i : i + 4096]
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([zz.tobytes()], pa.binary()), pa.array([zy.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["zz", "zy", "n"])

    def add(batches):
        zz, zy, n = np.zeros(size * size), np.zeros(size), 0
        for batch in batches:
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in ("zz", "zy", "n")), strict=True):
                zz, zy, n = zz + np.frombuffer(a), zy + np.frombuffer(b), n + c
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([zz.tobytes()], pa.binary()), pa.array([zy.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["zz", "zy", "n"])

    schema = "zz binary, zy binary, n long"
    parts, width = rows.mapInArrow(sums, schema), rows.rdd.getNumPartitions()
    while width > MERGED:  # a tree of merges: no task adds up more than about MERGED sums
        width = -(-width // MERGED)
        parts = parts.repartition(width).mapInArrow(add, schema)
    parts = parts.collect()
    zz = sum(np.frombuffer(r.zz) for r in parts).reshape(size, size)
    zy, n = sum(np.frombuffer(r.zy) for r in parts), sum(r.n for r in parts)
    model.weights = np.linalg.solve(zz + ridge * n / size * np.eye(size), zy)

    def cells(batches):
        for batch in batches:
            raw = np.round(np.clip(model.raw(matrix(batch.column(DESCRIBED))), -1, 2) / GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("__y")], names=["cell", "y"])

    grid = rows.mapInArrow(cells, "cell long, y double").groupBy("cell").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("cell").toArrow()
    cell, y, n = (grid.column(c).to_numpy().astype(float) for c in ("cell", "y", "n"))
    model.knots, model.levels = isotonic(cell * GRID, y, n)
    return model


def score(described: DataFrame, model: Model | None, keep=None, threshold: float = 0.7) -> DataFrame:
    """described with score (0 to 1) and predicted (1 from `threshold` on). Without a
    model every score is 0.5. Columns named score or predicted are replaced."""
    names = [c for c in carried(described, keep, ["score", "predicted"]) if c != DESCRIBED]
    schema = T.StructType([described.schema[c] for c in names] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = share(described.sparkSession, model)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(DESCRIBED))
            s = np.full(len(x), 0.5) if shared() is None else shared().score(x)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return described.select(*[F.col(f"`{c}`") for c in names], DESCRIBED).mapInArrow(run, schema)

"""Boosted trees for all classes at once (softmax) and for a return, as Spark jobs.

Features are cut into bins by quantiles. A round grows one tree for each class and one for
the return together: for each level one job adds up, in every partition, the gradients and
hessians of the rows by tree, node, feature and bin, and the driver picks the splits from
the sums, whose number depends on neither rows nor partitions. Gradients are summed as
integers, so the trees do not depend on how rows are dealt. Rows of a round and features of
a tree are drawn by hash. Every few rounds the rows are written again with their margins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.bars import kept
from .metrics import with_weights


@dataclass(frozen=True)
class Options:
    """Parameters. Trees, depth, rate, shares and seed are those of the
    training job."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.02
    row_share: float = 0.4
    feature_share: float = 0.4
    seed: int = 42
    bins: int = 64
    penalty: float = 1.0  # on the squares of leaf values
    least_hessian: float = 1.0  # of a child
    rows_a_task: int = 50_000
    every: int = 25  # rounds between two writings of the margins


@dataclass
class Round:
    """The trees of a round, as heaps: node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes, -1 for none
    cut: np.ndarray  # rows whose bin is above it go right
    gain: np.ndarray
    value: np.ndarray  # trees x nodes, of leaves

    def places(self, bins: np.ndarray, tree: int, depth: int) -> np.ndarray:
        """The node of each row after `depth` levels."""
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(depth):
            inner = at < self.feature.shape[1]
            feature = np.where(inner, self.feature[tree][np.minimum(at, self.feature.shape[1] - 1)], -1)
            right = bins[rows, np.maximum(feature, 0)] > self.cut[tree][np.minimum(at, self.feature.shape[1] - 1)]
            at = np.where(feature >= 0, 2 * at + 1 + right, at)
        return at

    def values(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return np.stack([self.value[k][self.places(bins, k, depth)] for k in range(len(self.value))], axis=1)


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]  # for each feature: the upper ends of its bins but the last
    classes: int
    rounds: list[Round]
    options: Options

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows of features; missing values are in the last bin."""
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), self.classes + 1))
        for r in self.rounds:
            out += r.values(bins, self.options.depth)
        return out


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def spread_bits(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of a hash."""
    x = np.asarray(x, dtype=np.uint64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def drawn_rows(key: np.ndarray, number: int, options: Options) -> np.ndarray:
    """Which rows a round uses."""
    salt = spread_bits(np.array([options.seed * 1_000_003 + number]))
    return spread_bits(key.view(np.uint64) ^ salt) < np.uint64(int(options.row_share * 2.0**63) * 2)


def drawn_features(n: int, number: int, tree: int, options: Options) -> np.ndarray:
    """The features that a tree may split, rising."""
    salt = (options.seed * 1_000_003 + number) * 64 + tree + 1
    order = np.argsort(spread_bits(np.arange(n, dtype=np.uint64) + np.uint64(salt << 16)), kind="stable")
    return np.sort(order[: max(1, int(n * options.feature_share))])


def gradients(margins: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray, classes: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of each row for each tree, as whole numbers of 1/scale."""
    p = softmax(margins[:, :classes])
    g = np.column_stack([(p - (label[:, None] == np.arange(classes))) * weight[:, None], margins[:, classes] - target])
    h = np.column_stack([np.maximum(2 * p * (1 - p), 1e-16) * weight[:, None], np.ones(len(target))])
    return np.rint(g * scale).astype(np.int64), np.rint(h * scale).astype(np.int64)


def best_splits(g: np.ndarray, h: np.ndarray, allowed: list[np.ndarray], options: Options) -> list[list[tuple | None]]:
    """For each tree and node the best (gain, feature, cut, left G, left H, right G, right
    H) by sums (trees x nodes x features x bins), the first of equal ones; None if no split
    gains."""
    out = []
    for k in range(len(g)):
        found: list[tuple | None] = []
        for node in range(g.shape[1]):
            left_g, left_h = (np.cumsum(x[k, node][allowed[k]], axis=1) for x in (g, h))
            all_g, all_h = left_g[:, -1:], left_h[:, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            score = lambda a, b: a * a / (b + options.penalty)
            gain = score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h)
            gain[(left_h < options.least_hessian) | (right_h < options.least_hessian)] = -1
            gain[:, -1] = -1
            at = int(gain.argmax())
            i, b = divmod(at, gain.shape[1])
            top = float(gain[i, b])
            found.append((top, int(allowed[k][i]), b, *(float(x[i, b]) for x in (left_g, left_h, right_g, right_h))) if top > 1e-12 else None)
        out.append(found)
    return out


ROW = T.StructType([T.StructField(n, k) for n, k in (("key", T.LongType()), ("bins", T.BinaryType()), ("label", T.IntegerType()), ("weight", T.DoubleType()), ("target", T.DoubleType()), ("margins", T.BinaryType()))])


def _arrays(batch, n_features: int, outputs: int):
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(n, n_features)
    margins = np.frombuffer(b"".join(batch.column("margins").to_pylist()), dtype="<f8").reshape(n, outputs)
    return bins, margins, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "label", "weight", "target"))


def quantiles(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """For each feature the rising ends of its bins, from one pass."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), at, 10_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q or [], dtype=np.float64)) for q in found]


def fit(train: DataFrame, features: list[str], label: str = "target_d", target: str = "target_p", keys=("symbol", "position"), classes: int = 3, **changes) -> Boosted:
    """Trees for the classes 0, 1, ... of label, with balanced class weights, and for
    target, without. Rows without a label or target are left out; no rows raise
    ValueError. Rows with equal keys are drawn alike."""
    options = replace(Options(), **changes)
    rows = with_weights(train.where(F.col(label).isNotNull() & F.col(target).isNotNull()), label)
    outputs = classes + 1
    model = Boosted(list(features), quantiles(rows, features, options.bins), classes, [], options)
    binned = model.binned

    def prepare(batches):
        for batch in batches:
            x = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(features))])
            bins, nothing = binned(x), np.zeros(outputs).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([b.tobytes() for b in bins], pa.binary()), batch.column("label"), batch.column("weight"), batch.column("target"), pa.array([nothing] * len(x), pa.binary())], schema_names)

    schema_names = ROW.names
    n, heaviest = rows.agg(F.count("*"), F.max("weight")).first()
    if not n:
        raise ValueError("no rows to learn from")
    tasks = max(1, math.ceil(n / options.rows_a_task))
    chosen = rows.select(F.xxhash64(*keys).alias("key"), F.col(label).cast("int").alias("label"), F.col("weight").cast("double").alias("weight"), F.col(target).cast("double").alias("target"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    table = kept(chosen.repartition(tasks, "key").mapInArrow(prepare, ROW))
    # sums of whole numbers that stay below 2**61, and below 2**53 in a batch
    scale = 2.0 ** min(36, 61 - math.ceil(math.log2(n * max(1.0, heaviest) + 1)))
    for number in range(options.trees):
        allowed = [drawn_features(len(features), number, k, options) for k in range(outputs)]
        inner, nodes = 2**options.depth - 1, 2 ** (options.depth + 1) - 1
        now = Round(np.full((outputs, inner), -1), np.zeros((outputs, inner), dtype=np.int64), np.zeros((outputs, inner)), np.zeros((outputs, nodes)))
        since = model.rounds[number // options.every * options.every :]
        for level in range(options.depth):
            g, h = sums(table, since, now, level, number, allowed, len(features), classes, scale, options)
            for k, found in enumerate(best_splits(g, h, allowed, options)):
                for i, split in enumerate(found):
                    place = 2**level - 1 + i
                    if split is None or (level and now.feature[k, (place - 1) // 2] < 0):
                        continue
                    now.gain[k, place], now.feature[k, place], now.cut[k, place] = split[:3]
                    for side, (a, b) in enumerate((split[3:5], split[5:7])):
                        now.value[k, 2 * place + 1 + side] = -options.rate * a / (b + options.penalty)
            if level == 0:  # a tree without a split is its root
                for k in np.flatnonzero(now.feature[:, 0] < 0):
                    a, b = (float(x[k, 0, allowed[k][0]].sum()) for x in (g, h))
                    now.value[k, 0] = -options.rate * a / (b + options.penalty)
            if not (now.feature[:, 2**level - 1 : 2 ** (level + 1) - 1] >= 0).any():
                break
        model.rounds.append(now)
        if (number + 1) % options.every == 0 and number + 1 < options.trees:
            table = kept(moved(table, model.rounds[-options.every :], len(features), outputs, options))
    return model


def moved(table: DataFrame, rounds: list[Round], n_features: int, outputs: int, options: Options) -> DataFrame:
    """table with the rounds' values added to the margins."""

    def run(batches):
        for batch in batches:
            bins, margins, *_ = _arrays(batch, n_features, outputs)
            for r in rounds:
                margins = margins + r.values(bins, options.depth)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], pa.array([m.tobytes() for m in margins], pa.binary())], names)

    names = ROW.names
    return table.mapInArrow(run, ROW)


def sums(table: DataFrame, since: list[Round], now: Round, level: int, number: int, allowed: list[np.ndarray], n_features: int, classes: int, scale: float, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians by tree, node of the level, feature and bin, from one job."""
    outputs, nodes, bins_of = classes + 1, 2**level, options.bins
    shape = (outputs, nodes, n_features, bins_of)

    def run(batches):
        total = np.zeros((2, *shape), dtype=np.int64)
        for batch in batches:
            bins, margins, key, label, weight, target = _arrays(batch, n_features, outputs)
            use = drawn_rows(key, number, options)
            bins, margins, label, weight, target = (x[use] for x in (bins, margins, label, weight, target))
            for r in since:
                margins = margins + r.values(bins, options.depth)
            g, h = gradients(margins, label, weight, target, classes, scale)
            for k in range(outputs):
                node = now.places(bins, k, level) - (nodes - 1)
                inside = node >= 0  # others stopped at a leaf before
                for f in allowed[k]:
                    cell = node[inside] * bins_of + bins[inside, f]
                    for which, x in enumerate((g, h)):
                        total[which, k, :, f] += np.bincount(cell, weights=x[inside, k], minlength=nodes * bins_of).astype(np.int64).reshape(nodes, bins_of)
        at = np.flatnonzero(total[1].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0].ravel()[at]), pa.array(total[1].ravel()[at])], ["cell", "g", "h"])

    found = table.mapInArrow(run, "cell int, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = np.zeros((2, int(np.prod(shape))))
    for which, c in enumerate(("g", "h")):
        out[which, found.column("cell").to_numpy()] = found.column(c).to_numpy() / scale
    return out[0].reshape(shape), out[1].reshape(shape)


def predict(model: Boosted, rows: DataFrame) -> DataFrame:
    """The result table: actual and predicted class, confidence (the largest class
    probability), actual and predicted return. Ties go to the lower class."""
    keys = ["symbol", "Datetime", "position", "part"]
    chosen = rows.select(*keys, F.col("target_d").cast("int").alias("actual_d"), F.col("target_p").cast("double").alias("actual_p"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(model.features)])
    width = len(model.features)
    names = [*keys, "actual_d", "predicted_d", "confidence", "actual_p", "predicted_p"]
    kinds = {f.name: f.dataType for f in chosen.schema} | {"predicted_d": T.IntegerType(), "confidence": T.DoubleType(), "predicted_p": T.DoubleType()}

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(np.float64) for i in range(width)])
            margins = model.margins(model.binned(x))
            p = softmax(margins[:, : model.classes])
            made = {"predicted_d": pa.array(p.argmax(axis=1).astype(np.int32)), "confidence": pa.array(p.max(axis=1)), "predicted_p": pa.array(margins[:, model.classes])}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names)

    return chosen.mapInArrow(run, T.StructType([T.StructField(n, kinds[n]) for n in names]))


def importances(model: Boosted, spark) -> DataFrame:
    """Mean gain of a feature's splits in the classes' trees, as a share of all features'
    means, largest first."""
    gain, n = np.zeros(len(model.features)), np.zeros(len(model.features))
    for r in model.rounds:
        for k in range(model.classes):
            for f, x in zip(r.feature[k], r.gain[k], strict=True):
                if f >= 0:
                    gain[f] += x
                    n[f] += 1
    mean = gain / np.maximum(n, 1)
    share = mean / (mean.sum() or 1.0)
    return spark.createDataFrame([(c, float(s)) for c, s in zip(model.features, share, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")

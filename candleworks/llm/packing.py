"""Packing of documents into sequences by linear grouping.

Only the counts of piece lengths matter for the plan, and lengths are at most the
capacity, so the plan is made on the driver from a table of fixed size. Large lengths
are sorted and put into groups of equal cardinality, each rounded up to its largest;
patterns of these few sizes are optimised (a linear programme over patterns, columns
generated by a knapsack); actual lengths are substituted, largest first; what is left
and the small lengths are best-fitted into the room that is really there. Documents
then find their places by their rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable
from .tokens import Encoder

# ---------------------------------------------------------------- the plan


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    ordered, worth = sizes[order], values[order]
    for c in range(1, capacity + 1):
        value[c], pick[c] = value[c - 1], -1
        k = int(np.searchsorted(ordered, c, side="right"))
        if k:
            totals = value[c - ordered[:k]] + worth[:k]
            best = int(totals.argmax())
            if totals[best] > value[c] + 1e-12:
                value[c], pick[c] = totals[best], order[best]
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(value[capacity]), pattern


def optimise(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole multiplicities that cover no more than the demand: the
    rounded-down optimum of the pattern programme."""
    n = len(sizes)
    basis = [np.eye(n, dtype=np.int64)[i] * max(1, capacity // int(sizes[i])) for i in range(n)]
    for _ in range(rounds):
        columns = np.array(basis, dtype=float).T
        amounts = np.linalg.solve(columns, demand.astype(float))
        prices = np.linalg.solve(columns.T, np.ones(n))
        worth, pattern = best_pattern(sizes, np.maximum(prices, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(columns, pattern.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(amounts, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[out] = pattern
    amounts = np.linalg.solve(np.array(basis, dtype=float).T, demand.astype(float))
    left, found = demand.astype(np.int64).copy(), []
    for k in np.argsort(-amounts):
        used = basis[k] > 0
        times = min(int(np.floor(amounts[k] + 1e-6)), int((left[used] // basis[k][used]).min())) if used.any() else 0
        if times > 0:
            left -= basis[k] * times
            found.append((basis[k], times))
    return found


def best_fit(bins: list[tuple[tuple[int, ...], int]], lengths: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, for many equal bins and lengths at once. A bin that takes
    one of a length takes the next of it as well while it fits: its room is then the
    tightest."""
    by_room: dict[int, list[list]] = {}
    for pattern, times in bins:
        by_room.setdefault(capacity - sum(pattern), []).append([pattern, times])
    for length in sorted(lengths, reverse=True):
        n = lengths[length]
        rooms = sorted(r for r in by_room if r >= length)
        for room in rooms:
            fit, kept = room // length, []
            for pattern, times in by_room.pop(room):
                full = min(times, n // fit)
                if full:
                    by_room.setdefault(room - fit * length, []).append([pattern + (length,) * fit, full])
                    n -= full * fit
                rest = times - full
                if rest and n:  # fewer than would fill it
                    by_room.setdefault(room - n * length, []).append([pattern + (length,) * n, 1])
                    n, rest = 0, rest - 1
                if rest:
                    kept.append([pattern, rest])
            if kept:
                by_room.setdefault(room, []).extend(kept)
            if not n:
                break
        fit = capacity // length
        if n >= fit:
            by_room.setdefault(capacity - fit * length, []).append([(length,) * fit, n // fit])
            n %= fit
        if n:
            by_room.setdefault(capacity - n * length, []).append([(length,) * n, 1])
    return [(pattern, times) for same in by_room.values() for pattern, times in same]


def grouped(counts: Counter, capacity: int, groups: int, small: int) -> list[tuple[tuple[int, ...], int]]:
    """One plan by linear grouping with at most so many groups of large lengths."""
    large = sorted((x for x in counts if x > small), reverse=True)
    total = sum(counts[x] for x in large)
    members: list[list[int]] = []
    taken = 0
    for x in large:
        if not members or (taken * groups) // max(1, total) >= len(members):
            members.append([])
        members[-1].append(x)
        taken += counts[x]
    sizes = np.array([m[0] for m in members], dtype=np.int64)
    demand = np.array([sum(counts[x] for x in m) for m in members], dtype=np.int64)
    left = Counter(counts)
    queue = [[[x, counts[x]] for x in m] for m in members]
    bins: list[tuple[tuple[int, ...], int]] = []

    def take(group: int, most: int) -> tuple[int, int]:
        """The next actual length of a group, and how many of it at most."""
        while not queue[group][0][1]:
            queue[group].pop(0)
        return queue[group][0][0], min(most, queue[group][0][1])

    for pattern, times in optimise(sizes, demand, capacity) if len(sizes) else ():
        slots = [g for g in range(len(sizes)) for _ in range(int(pattern[g]))]
        while times:
            chosen, run, used = [], times, Counter()
            for g in slots:  # the longest run of bins that all get the same actual lengths
                used[g] += 1
            for g in used:
                length, n = take(g, times * used[g])
                run = min(run, max(1, n // used[g]))
            if run == 1:
                for g in slots:
                    length, _ = take(g, 1)
                    queue[g][0][1] -= 1
                    chosen.append(length)
            else:
                for g in used:
                    length, _ = take(g, 1)
                    queue[g][0][1] -= run * used[g]
                    chosen += [length] * used[g]
            bins.append((tuple(chosen), run))
            for length in chosen:
                left[length] -= run
            times -= run
    return best_fit(bins, +left, capacity)


#: Numbers of groups, and the share of the capacity up to which a length is small.
TRIES = ((64, 1 / 8), (64, 1 / 4), (64, 1 / 3), (16, 1 / 2))


def plan(counts: dict[int, int], capacity: int, tries=TRIES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) and how often each is used: the shortest of
    the plans for several numbers of groups and bounds of small lengths."""
    counts = Counter({int(k): int(v) for k, v in counts.items() if v})
    full = counts.pop(capacity, 0)
    found = [grouped(counts, capacity, groups, int(capacity * small)) for groups, small in tries] if counts else [[]]
    best = min(found, key=lambda bins: sum(times for _, times in bins))
    return ([((capacity,), full)] if full else []) + best


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset), by first rank."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for pattern, times in bins:
        offset = 0
        for length in pattern:
            rows.setdefault(length, []).append((ranks[length], sequence, offset))
            ranks[length] += times
            offset += length
        sequence += times
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


# ---------------------------------------------------------------- the job


def pieces(docs: DataFrame, capacity: int, end_id: int, text_col: str, keep, place: str | None) -> DataFrame:
    """One row for each piece: carried columns (as keep_<name>), piece, start, length,
    ids_crc32, and its task and number among the task's pieces of that length. Only documents of
    more than `capacity` ids are cut; their first piece takes the remainder."""
    made = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    encoder = Encoder(place)
    fields = [T.StructField(n, T.IntegerType() if n == "piece" else T.LongType()) for n in (*made[:4], "__task", "__nth")]
    rows_of = docs.select(*[F.col(f"`{c}`").alias(f"keep_{c}") for c in names], F.col(text_col).alias("__text"))
    schema = T.StructType([rows_of.schema[f"keep_{c}"] for c in names] + fields)

    def run(batches):
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for d, text in enumerate(batch.column("__text").to_pylist()):
                ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, seen[b - a]))
                    seen[b - a] += 1
            made_rows = np.array(rows, dtype=np.int64).reshape(-1, 7)
            taken = pa.array(made_rows[:, 0])
            arrays = [batch.column(f"keep_{c}").take(taken) for c in names]
            arrays += [pa.array(made_rows[:, 1].astype(np.int32))] + [pa.array(made_rows[:, k]) for k in range(2, 7)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows_of.mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, text_col: str = "text", keep=None, place: str | None = None) -> DataFrame:
    """One row for each piece of docs, with sequence_id and offset in the sequence.

    Null and empty texts are one piece of the end id alone. Equal documents are
    packed one by one. Columns of docs named like the results are replaced.
    """
    cut = durable(pieces(docs, capacity, end_id, text_col, keep, place))
    counts = durable(cut.groupBy("__task", "length").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))
    ranked = cut.join(bases, ["__task", "length"]).withColumn("__rank", F.col("__nth") + F.col("__base"))
    names = [c for c in cut.columns if c not in ("__task", "__nth")]
    schema = T.StructType([T.StructField(c.removeprefix("keep_"), cut.schema[c].dataType) for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place_all(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for x in np.unique(length):
                mine = length == x
                table = where.value[int(x)]
                at = np.searchsorted(table[:, 0], rank[mine], side="right") - 1
                sequence[mine] = table[at, 1] + rank[mine] - table[at, 0]
                offset[mine] = table[at, 2]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.select(*names, "__rank").mapInArrow(place_all, schema)

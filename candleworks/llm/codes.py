"""Vector code compression: integer product codes, nearest entries by a GNAT.

Components become integers, vectors are cut into equal parts, and each part is replaced
by the number of the nearest entry of its position's codebook. Codebooks are refined in
rounds: tasks add up the parts of each entry, Spark adds up the tasks, and the driver
divides, all in integers, so that the result does not depend on how rows are dealt.

The nearest entry comes from a geometric near-neighbour access tree over the entries. A
node has a few split points; every other entry belongs to the child of its nearest one.
The node holds, for each split point and child, the range of their distances. A query
that lies d from a split point and has found an entry at r leaves out each child whose
range ends before d - r or begins after d + r. Bounds are rounded outwards, so only
children all of whose entries lie strictly farther are left out; what remains is compared
by exact squares, ties going to the lower entry.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, durable, join_each, release, share

#: Integer components are below this, so that squared distances are exact in 64 bits.
LIMIT = 1 << 26

#: Labels and their sums that are broadcast at most.
MANY = 100_000


@dataclass
class Node:
    points: np.ndarray  # entries
    children: list[Node | None] = field(default_factory=list)  # one for each point
    low: np.ndarray | None = None  # points x children: least distance, rounded down
    high: np.ndarray | None = None


class Gnat:
    """Tree over the rows of `entries` (integers)."""

    def __init__(self, entries: np.ndarray, degree: int = 4):
        self.entries, self.degree = np.asarray(entries, dtype=np.int64), degree
        self.root = self._node(np.arange(len(self.entries)))

    def _squares(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((self.entries[a][:, None] - self.entries[b]) ** 2).sum(axis=2)

    def _node(self, members: np.ndarray) -> Node:
        if len(members) <= self.degree:
            return Node(members)
        picked = [0]  # split points far from each other
        apart = self._squares(members, members[:1])[:, 0]
        while len(picked) < self.degree:
            apart[picked] = -1
            picked.append(int(apart.argmax()))
            apart = np.minimum(apart, self._squares(members, members[picked[-1:]])[:, 0])
        points = members[picked]
        rest = np.delete(members, picked)
        own = self._squares(rest, points).argmin(axis=1)
        low, high = np.zeros((len(points), len(points))), np.full((len(points), len(points)), -1.0)
        children: list[Node | None] = []
        for j in range(len(points)):
            group = rest[own == j]
            children.append(self._node(group) if len(group) else None)
            if len(group):
                d = np.sqrt(self._squares(points, group).astype(np.float64))
                low[:, j], high[:, j] = np.floor(d.min(axis=1)) - 1, np.ceil(d.max(axis=1)) + 1
        return Node(points, children, low, high)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x, the lowest of equally near ones, and the
        squared distance to it."""
        x = np.asarray(x, dtype=np.int64)
        best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), dtype=np.int64)

        def visit(node: Node, rows: np.ndarray) -> None:
            squares = ((x[rows][:, None] - self.entries[node.points]) ** 2).sum(axis=2)
            for c, entry in enumerate(node.points):
                d = squares[:, c]
                better = (d < best[rows]) | ((d == best[rows]) & (entry < at[rows]))
                best[rows[better]], at[rows[better]] = d[better], entry
            if node.low is None:
                return
            d = np.sqrt(squares.astype(np.float64))
            least, most = np.floor(d) - 1, np.ceil(d) + 1
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                reach = (np.ceil(np.sqrt(best[rows].astype(np.float64))) + 1)[:, None]
                out = (least - reach > node.high[:, j]) | (most + reach < node.low[:, j])
                inside = rows[~out.any(axis=1)]
                if len(inside):
                    visit(child, inside)

        if len(x) and len(self.entries):
            visit(self.root, np.arange(len(x)))
        return at, best


@dataclass
class Codebooks:
    entries: list[np.ndarray]  # for each part position: entries x its width

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    def trees(self) -> list[Gnat]:
        return [Gnat(e) for e in self.entries]

    def digest(self) -> str:
        """SHA-256 of all components as decimal text, by part, entry and place."""
        return hashlib.sha256(",".join(str(int(v)) for e in self.entries for v in e.ravel()).encode()).hexdigest()


def integers(column, scale: int) -> np.ndarray:
    """Rows of an Arrow list column, all of one width, as integers floor(scale * x)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(values) and np.abs(values).max() >= LIMIT:
        raise ValueError(f"components must be below {LIMIT // scale} in size")
    return values.astype(np.int32).reshape(len(column), -1)


def rows_of(column, width: int) -> np.ndarray:
    """Rows of integers from a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(len(column), width).astype(np.int64)


def prepared(vectors: DataFrame, vector_col: str, id_col: str, label_col: str, keep: list[str], parts: int, scale: int) -> tuple[DataFrame, int]:
    """Written rows (carried columns, id, label, ints) of sound vectors, and their width."""
    value = F.col(vector_col)
    sound = F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(value) > 0), F.lit(False))
    rows = vectors.where(sound).select(*[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep], F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), value.alias("v"))
    names = [c for c in rows.columns if c != "v"]

    def pack(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                some = batch.slice(i, 8192)
                sizes = np.diff(some.column("v").offsets.to_numpy())
                if (sizes != sizes[0]).any():
                    raise ValueError("vectors of different widths")
                ints = integers(some.column("v"), scale)
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names], pa.array([r.tobytes() for r in ints], pa.binary())], names=[*names, "ints"])

    table = durable(rows.mapInArrow(pack, T.StructType([rows.schema[c] for c in names] + [T.StructField("ints", T.BinaryType())])))
    least, most = table.agg(F.min(F.octet_length("ints")), F.max(F.octet_length("ints"))).first()
    if least != most:
        raise ValueError("vectors of different widths")
    width = (most or 0) // 4
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    return table, width


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks whose entries are the means, rounded down, of the parts nearest to them;
    entries without parts stay."""
    parts, width = len(books.entries), books.width
    model = share(rows.sparkSession, books)

    def added(batches):
        sums = [np.zeros_like(e) for e in model().entries]
        counts = [np.zeros(len(e), dtype=np.int64) for e in model().entries]
        trees = model().trees()
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                x = rows_of(batch.column("ints").slice(i, 8192), parts * width)
                for p, tree in enumerate(trees):
                    part = x[:, p * width : (p + 1) * width]
                    at, _ = tree.nearest(part)
                    counts[p] += np.bincount(at, minlength=len(counts[p]))
                    which = (at[:, None] == np.arange(len(counts[p]))).astype(np.float64)
                    sums[p] += (which.T @ part).astype(np.int64)  # below 2**53
        cell = [p << 16 | e for p in range(parts) for e in np.flatnonzero(counts[p])]
        n = [int(counts[c >> 16][c & 0xFFFF]) for c in cell]
        columns = [pa.array([int(sums[c >> 16][c & 0xFFFF][k]) for c in cell], pa.int64()) for k in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(n, pa.int64()), *columns], names=["cell", "n", *[f"s{k}" for k in range(width)]])

    schema = "cell int, n long" + "".join(f", s{k} long" for k in range(width))
    found = rows.select("ints").mapInArrow(added, schema).groupBy("cell").agg(F.sum("n"), *[F.sum(f"s{k}") for k in range(width)])
    entries = [e.copy() for e in books.entries]
    for cell, n, *s in found.collect():  # a row for each entry
        entries[cell >> 16][cell & 0xFFFF] = [v // n for v in s]
    return Codebooks(entries)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", keep=None) -> tuple[DataFrame, Codebooks | None]:
    """(table, codebooks): vectors with code (an entry's number for each part, two hex
    digits each), error (squared distance to the coded vector) and label_error (error
    summed over equal labels, null being one).

    Vectors that are null, empty or hold a null, NaN or infinite component are dropped.
    Codebooks start as the parts of the vectors with the smallest ids (null ids last,
    equal ids by their integers); with fewer vectors than `entries` they are smaller,
    with none there is no codebook. Different widths, a width that `parts` does not
    divide and components of 16384 or more (at the scale of 4096) raise ValueError.
    Repeated rows stay. Columns of vectors named like the results are replaced.
    """
    made = ["code", "error", "label_error"]
    names = carried(vectors, keep, made)
    schema = T.StructType([T.StructField(c, vectors.schema[c].dataType) for c in names])
    rows, width = prepared(vectors, vector_col, id_col, label_col, names, parts, scale)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    if not first:
        none = schema.add("code", "string").add("error", "long").add("label_error", "long")
        return vectors.sparkSession.createDataFrame([], none), None
    begin = np.stack([np.frombuffer(r.ints, dtype="<i4") for r in first]).astype(np.int64)
    books = Codebooks(np.split(begin, parts, axis=1))
    for _ in range(rounds):
        books = refined(rows, books)
    model = share(vectors.sparkSession, books)
    kept = [f"keep_{c}" for c in names]

    def coded(batches):
        trees = model().trees()
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                some = batch.slice(i, 8192)
                x = rows_of(some.column("ints"), width)
                code, error = np.empty((len(x), parts), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
                for p, tree in enumerate(trees):
                    at, d = tree.nearest(x[:, p * width // parts : (p + 1) * width // parts])
                    code[:, p] = at
                    error += d
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in [*kept, "label"]], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=[*kept, "label", "code", "error"])

    out = T.StructType([rows.schema[c] for c in [*kept, "label"]] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    found = durable(rows.select(*kept, "label", "ints").mapInArrow(coded, out).withColumn("key", F.coalesce(F.concat(F.lit("v"), "label"), F.lit("-"))).drop("label"))
    release(rows)
    sums = durable(found.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    n_labels, total = sums.agg(F.count("*"), F.sum("n")).first()
    met = found.join(F.broadcast(sums.drop("n")), "key") if n_labels <= MANY else join_each(found, sums, "key", "n", total)
    return met.select(*[F.col(f"`keep_{c}`").alias(c) for c in names], *made), books

"""Token ids in packed binary rows.

Documents become ids plus an end id; those longer than a row are split into full rows
and a remainder, so that joining a document's pieces in order gives its ids back. The
pieces of a pool (all that a task reads, up to `pool` remainders) are packed by
best-fit decreasing; a segment tree over capacities finds the fullest row that still
has room. Every packed row is written with its ids (padded, little-endian), the
cumulative lengths of its segments and position ids that start again with each
segment. Pools need no shuffle and bound a task's memory; one row for each pool is
left partly empty at most where small pieces fill the others.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder
from .tokens import Encoder



def row_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("input_ids", T.BinaryType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("position_ids", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(id_type)),
        T.StructField("starts", T.ArrayType(T.LongType())),
    ])


class CapacityTree:
    """How many open rows have each room 0..capacity; smallest room of at least x."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def smallest(self, least: int) -> int | None:
        k = least + self.leaves
        if self.count[k]:
            return least
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the pieces in each row; equal lengths in the order given."""
    tree, open_rows, rows = CapacityTree(capacity), {}, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        room = tree.smallest(size)
        if room is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        open_rows.setdefault(room - size, []).append(row)
        tree.add(room - size, 1)
    return rows


def packed(docs: DataFrame, row: int = 2048, end_id: int = 50256, pad_id: int = 50256, text_col: str = "text", id_col: str = "doc_id", width: int = 2, pool: int = 8192, place: str | None = None) -> DataFrame:
    """Packed rows of all docs. `width` is the bytes of an id (2 or 4); an id that does
    not fit raises. The strings of special tokens are ordinary text, so that no text can
    hold an end id of its own.

    Null and empty texts are one segment of the end id. doc_ids keeps the ids as they
    are, of any type and null. Repeated documents are packed one by one.
    """
    encoder = Encoder(place, special=False)
    kind = {2: "<u2", 4: "<u4"}[width]
    largest = (1 << 8 * width) - 1
    if max(end_id, pad_id) > largest:
        raise ValueError(f"end_id {end_id} or pad_id {pad_id} needs more than {width} bytes")
    schema = row_schema(docs.schema[id_col].dataType)

    def run(batches):
        waiting: list[tuple] = []  # remainders: (doc, start, ids)
        id_kind = pa.null()

        def emit(rows):
            columns = [[] for _ in schema.fields]
            for segments in rows:
                ids = np.full(row, pad_id, dtype=kind)
                positions = np.zeros(row, dtype="<u2" if row <= 1 << 16 else "<u4")
                ends = np.cumsum([0] + [len(s[2]) for s in segments])
                for (_, _, part), a, b in zip(segments, ends, ends[1:], strict=False):
                    ids[a:b] = part
                    positions[a:b] = np.arange(b - a)
                for column, value in zip(columns, (ids.tobytes(), int(ends[-1]), ends.astype(np.int32), positions.tobytes(), [s[0] for s in segments], [s[1] for s in segments]), strict=True):
                    column.append(value)
            kinds = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(id_kind), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

        def fitted():
            lengths = np.array([len(w[2]) for w in waiting])
            rows = [[waiting[i] for i in members] for members in best_fit_decreasing(lengths, row)]
            waiting.clear()
            return rows

        for batch in batches:
            full, id_kind = [], batch.schema.field("__id").type
            for doc, text in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                ids = np.append(encoder.ids(text or ""), np.uint32(end_id))
                if int(ids.max()) > largest:
                    raise ValueError(f"token id {ids.max()} needs more than {width} bytes")
                ids = ids.astype(kind)
                whole = len(ids) - len(ids) % row
                full += [[(doc, a, ids[a : a + row])] for a in range(0, whole, row)]
                if whole < len(ids):
                    waiting.append((doc, whole, ids[whole:].copy()))
                if len(full) >= 1024:
                    yield emit(full)
                    full = []
                if len(waiting) >= pool:
                    ready = fitted()
                    for i in range(0, len(ready), 1024):
                        yield emit(ready[i : i + 1024])
            if full:
                yield emit(full)
        ready = fitted() if waiting else []
        for i in range(0, len(ready), 1024):
            yield emit(ready[i : i + 1024])

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def write(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the packed rows as Parquet (to a new folder beside the shared tables by
    default) and return them, read back, with row_id: part of the table and number."""
    path = path or f"{shared_folder(docs.sparkSession)}/packed-{uuid.uuid4().hex}"
    rows = packed(docs, **options).withColumn("row_id", F.monotonically_increasing_id())
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def documents(rows: DataFrame, width: int = 2) -> DataFrame:
    """The segments of packed rows: doc_id, start (ids of the document before it), ids
    (little-endian bytes), row_id, segment (its number in the row), offset and end (its
    cumulative lengths), positions (bytes of its position ids) and n_tokens of the row."""
    wide = (F.octet_length("position_ids") / (F.octet_length("input_ids") / width)).cast("int")

    def cut(k):
        a, b = F.get("cu_seqlens", k), F.get("cu_seqlens", k + 1)
        part = lambda column, size: F.substring(column, a * size + 1, (b - a) * size)
        values = {"doc_id": F.get("doc_ids", k), "start": F.get("starts", k), "ids": part("input_ids", F.lit(width)), "segment": k, "offset": a, "end": b, "positions": part("position_ids", wide)}
        return F.struct(*[v.alias(c) for c, v in values.items()])

    # cut before they are dealt out, so that no segment carries its whole row
    segments = rows.select("row_id", "n_tokens", F.explode(F.transform(F.sequence(F.lit(0), F.size("doc_ids") - 1), cut)).alias("s"))
    return segments.select("s.doc_id", "s.start", "s.ids", "row_id", "s.segment", "s.offset", "s.end", "s.positions", "n_tokens")

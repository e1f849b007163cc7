"""SimHash near-duplicates, linked by BK-trees.

A fingerprint is the bitwise majority of the XXH64 of a text's word shingles. Equal
fingerprints collapse first. Two fingerprints at `radius` 2 or less agree on at least
two of four 16-bit blocks, so each goes to six shards, one for each pair of blocks,
keyed by their bits; every shard is a BK-tree, queried along edges within the radius.
Shards meet their fingerprints by shuffle: a broadcast of all trees has no size bound.
A shard of more than `most` fingerprints is cut again on thirds of its free bits, of
which one must agree, until it is small or its free bits bound it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, join_each, map_text
from .components import components

RADIUS = 2
_BLOCKS = [0xFFFF << (16 * i) for i in range(4)]


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one text; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    stops = ends[size - 1 :].tolist()
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops, strict=False)], dtype=np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the unsigned 64-bit hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep=None, size: int = 3) -> DataFrame:
    """docs with `fingerprint`, a long holding the 64 bits; 0 for null or wordless texts."""

    def run(column):
        values = [fingerprint(t or b"", size) for t in column.cast(pa.binary()).to_pylist()]
        return [pa.array(np.array(values, dtype=np.uint64).view(np.int64))]

    return map_text(docs, text_col, keep, [T.StructField("fingerprint", T.LongType())], run)


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        k = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while k:
            d = (self.values[at] ^ value).bit_count()
            down = self.children[at].get(d)
            if down is None:
                self.children[at][d] = k
                return
            at = down

    def within(self, value: int, radius: int) -> list[int]:
        out, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                out.append(at)
            todo.extend(child for e, child in self.children[at].items() if d - radius <= e <= d + radius)
        return out


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within the radius that connect all that such links connect: a value that
    joins several trees of the forest gets one link to each."""
    tree, parent, links = BKTree(), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, value in enumerate(values):
        for other in tree.within(value, radius):
            if (r := root(other)) != k and root(k) != r:
                parent[r] = root(k)
                links.append((value, values[other]))
        tree.add(value)
    return links


def _linked(batches):
    """Links of rows (mask, key, fingerprint) that come sorted by mask and key."""

    def out(links):
        a = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    left = np.empty((0, 3), dtype=np.int64)
    for batch in batches:
        rows = np.column_stack([batch.column(c).to_numpy() for c in ("mask", "key", "fingerprint")])
        rows = np.concatenate([left, rows])
        cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        last = int(cut[-1]) if len(cut) else 0
        bounds = np.concatenate([[0], cut]) if len(rows) else cut
        links = []
        for i in np.flatnonzero(np.diff(bounds) > 1):
            links += forest(rows[bounds[i] : bounds[i + 1], 2].view(np.uint64).tolist())
        if links:
            yield out(links)
        left = rows[last:]
    if len(left) > 1:
        links = forest(left[:, 2].copy().view(np.uint64).tolist())
        if links:
            yield out(links)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def thirds(mask: int) -> list[int]:
    """The mask with each third of its free bits added."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << b for b in free[k::3]) for k in range(3)]


def links(nodes: DataFrame, most: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints: every two within the radius are
    connected by them, and each joins two within the radius."""
    masks = [_BLOCKS[i] | _BLOCKS[j] for i in range(4) for j in range(i)]

    def keyed(df: DataFrame, masks_of) -> DataFrame:
        rows = df.select("fingerprint", F.explode(masks_of).alias("mask"))
        return rows.withColumn("key", F.col("fingerprint").bitwiseAND(F.col("mask")))

    rows = keyed(nodes, F.array(*[F.lit(signed(m)) for m in masks]))
    parts = []
    while True:
        free = 64 - masks[0].bit_count()
        hot = None
        if (1 << free) > most:
            hot = durable(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mask", "key"))
            if hot.isEmpty():
                hot = None
        parts.append(rows if hot is None else rows.join(hot, ["mask", "key"], "left_anti"))
        if hot is None:
            break
        finer = F.create_map(*[x for m in masks for x in (F.lit(signed(m)), F.array(*[F.lit(signed(t)) for t in thirds(m)]))])
        rows = keyed(rows.join(hot, ["mask", "key"], "left_semi").select("fingerprint", F.element_at(finer, F.col("mask")).alias("__m")), F.col("__m")).distinct()
        masks = sorted({t for m in masks for t in thirds(m)})
    every = parts[0].select("mask", "key", "fingerprint")
    for part in parts[1:]:
        every = every.union(part.select("mask", "key", "fingerprint"))
    return every.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep=None, size: int = 3, most: int = 1024) -> DataFrame:
    """docs with fingerprint (long) and component_id: the smallest id reachable over
    fingerprints at two or fewer differing bits, the row's own included.

    Null, empty and wordless texts have fingerprint 0, and so link with each other. A
    null id is never a component's smallest; a component of null ids has a null one.
    Repeated rows stay as they are. Columns of docs named like the results are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("fingerprint", "component_id")]
    carried = [f"keep_{c}" for c in names]
    body = f"keep_{text_col}" if text_col in names else "__body"
    rows = docs.select(*[F.col(f"`{c}`").alias(f"keep_{c}") for c in names], F.col(id_col).alias("__id"), *([] if text_col in names else [F.col(text_col).alias("__body")]))
    marked = durable(fingerprints(rows, body, [*carried, "__id"], size))
    nodes = durable(marked.groupBy("fingerprint").agg(F.min("__id").alias("least"), F.count("*").alias("rows")))
    roots = components(links(nodes.select("fingerprint"), most)).withColumnRenamed("node", "fingerprint")
    of = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    table = of.join(least, "root").select("fingerprint", "component_id", "rows")
    total = nodes.agg(F.sum("rows")).first()[0] or 0
    return join_each(marked, table, "fingerprint", "rows", total).select(*[F.col(f"`keep_{c}`").alias(c) for c in names], "fingerprint", "component_id")


def hexadecimal(column: str = "fingerprint"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without those whose component has a smaller id. Repeated rows of the
    smallest id stay, as do rows without an id that link with none that has one."""
    found = near_duplicates(docs, text_col, id_col)
    kept = found.where(F.col("component_id").isNull() | (F.col("component_id") == F.col(id_col)))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

"""What the operators share: Arrow batches in and out, word spans, durable tables."""

from __future__ import annotations

import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 2 << 20


# ---------------------------------------------------------------- durable tables


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where
    that is unset a temporary one, in local mode alone, kept in a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark.conf.get("candleworks.scratch", None) or tempfile.mkdtemp(prefix="spark-candleworks-")
        spark.conf.set("candleworks.scratch", folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start from the
    files, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.durable_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that `durable` wrote, once all that was made of them is itself
    written; others are left alone."""
    for table in tables:
        path = getattr(table, "__dict__", {}).pop("durable_path", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def join_each(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, most: int = 100_000) -> DataFrame:
    """left joined to right on key, without the column `rows`. right has one row for a
    key, and `rows` says how many of the `total` rows of left have it. Keys of more than
    1/1000 of all rows (and more than `most`) are at most 1000: these are broadcast and
    their rows stay where they are, so no task gets all rows of one key; the others
    meet by shuffle."""
    if total <= most:
        return left.join(right.drop(rows), key)
    hot = F.broadcast(right.where(F.col(rows) > max(total // 1000, most)).drop(rows))
    cold = right.where(F.col(rows) <= max(total // 1000, most)).drop(rows)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))


def share(spark: SparkSession, value):
    """A function that gives value in tasks: broadcast as bytes that hold classes by
    value, so executors need no copy of the package."""
    raw = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    made: list = []

    def get():
        if not made:
            made.append(pickle.loads(raw.value))
        return made[0]

    return get


#: Bits of a bitmap of keys: at most, and for each key.
MAX_BITS, BITS_EACH = 1 << 28, 32


def bitmap_of(keys: DataFrame, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bytes of a bitmap with the bits of all values of the column `key` (longs) modulo
    its size, a power of two: about BITS_EACH bits for each key, but at most max_bits, so
    it can be broadcast however many keys there are. It says of some other keys that they
    are there, and of none that is that it is not."""
    n = keys.count()
    bits = 1 << 15
    while bits < min(BITS_EACH * n, max_bits):
        bits *= 2
    at = F.pmod("key", F.lit(bits)) + 1
    blocks = keys.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for b, block in blocks.collect():  # max_bits / 32768 rows of 4 KB at most
        out[(b - 1) * 4096 : (b - 1) * 4096 + 4096] = np.frombuffer(bytes(block), dtype=np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the keys may be among those of the bitmap."""
    at = (keys.astype(np.uint64) & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


# ---------------------------------------------------------------- Arrow batches


def text_column(name: str, alias: str = "__text"):
    return F.col(name).cast("string").alias(alias)


def carried(df: DataFrame, keep, made) -> list[str]:
    """Columns of df that go through an operator: those asked for (all by default)
    but for the ones whose names the operator itself writes."""
    taken = {m.lower() for m in made}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]


def map_text(df: DataFrame, text_col: str, keep, fields: list[T.StructField], fn, rows_too: bool = False) -> DataFrame:
    """fn(list-like Arrow column of texts) -> one Arrow array for each of fields,
    beside the carried columns. With rows_too, fn also returns a boolean array of
    the rows to keep."""
    names = carried(df, keep, [f.name for f in fields])
    made = [f.name for f in fields]
    schema = T.StructType([df.schema[c] for c in names] + fields)
    # a carried text goes to Python once
    source = f"keep_{text_col}" if text_col in names and df.schema[text_col].dataType == T.StringType() else "__text"

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn(batch.column(source))
            mask = None
            if rows_too:
                *out, mask = out
            made_batch = pa.RecordBatch.from_arrays([batch.column(f"keep_{c}") for c in names] + list(out), names=names + made)
            yield made_batch if mask is None else made_batch.filter(mask)

    texts = [text_column(text_col)] if source == "__text" else []
    return df.select(*[F.col(f"`{c}`").alias(f"keep_{c}") for c in names], *texts).mapInArrow(run, schema)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all the texts of an Arrow string column, and where each begins
    (one entry more than there are texts). Nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of documents of about `most` bytes each (one long document may be more)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---------------------------------------------------------------- words

#: ASCII white space: space and \x09 to \x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Lower-cases A-Z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans_of(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of bytes that are not in the
    table `outside`; runs end with their document."""
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    inside = ~outside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_RADIX = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = np.random.default_rng(20240613).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None, step: int = 1 << 19) -> np.ndarray:
    """64-bit hashes of byte spans that do not overlap, in order. A polynomial over
    random byte values modulo 2**64, from prefix sums; `table` maps bytes first."""
    values = _BYTE_VALUES if table is None else _BYTE_VALUES[table]
    out = np.empty(len(starts), dtype=np.uint64)
    up = down = np.empty(0, dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        if len(up) <= b - a:
            up, down = powers(_RADIX, b - a + 1), powers(pow(_RADIX, -1, 1 << 64), b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(values[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def held_out(id_col: str, folds: int, fold: int):
    """True for rows of the fold that learning leaves out: crc32 of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))

"""Benchmark decontamination with one Aho-Corasick automaton over word windows.

Items (questions, answers) and texts are normalised alike: A-Z in lower case,
words are runs of digits, letters and non-ASCII characters. Every run of `window`
words of an item becomes a pattern over word numbers; shorter items are one pattern.
The automaton reads each text once. Word numbers lead back to byte offsets of the
original text, so hits are reported as code-point spans of the text as it was.

Items are a stated query set. The automaton is built once, on the driver, after its
size is known from the number of windows, and broadcast; a task loads it once. A window
is numbered, and arrays list the items of each number.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, share

#: Word separators, as bytes: controls, ASCII punctuation and space.
_LOWERED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_LOWERED).split()


def load_items(items: DataFrame, item_col: str, item_text: str, max_bytes: int) -> list[tuple[str, bytes]]:
    """The items on the driver, after a check of their size: they go to every task."""
    total = items.agg(F.sum(F.octet_length(F.col(item_text)))).first()[0] or 0
    if total > max_bytes:
        raise ValueError(f"{total} bytes of items; raise max_bytes if driver and tasks have the memory")
    rows = items.select(F.col(item_col).cast("string"), F.col(item_text)).where(F.col(item_text).isNotNull()).toArrow()
    return [(str(i), t.encode()) for i, t in zip(*(c.to_pylist() for c in rows.columns), strict=True)]


#: Most bytes of an automaton for each word of a window: 13 words take at most about
#: 13 nodes, measured at 62 bytes each.
NODE_BYTES = 64


@dataclass
class Windows:
    numbers: dict[bytes, int]  # of the words of items, from 1
    names: list[str]  # of the items, sorted
    machine: ahocorasick.Automaton | None  # of word numbers; ends give the window's number
    size: np.ndarray  # words of each window
    first: np.ndarray  # where the items of each window begin in `items`
    items: np.ndarray

    def owners(self, window: int) -> list[int]:
        return self.items[self.first[window] : self.first[window + 1]].tolist()


def build(items: list[tuple[str, bytes]], window: int, max_bytes: int) -> Windows:
    """One automaton for all windows of the items; ValueError if it could need more
    than max_bytes."""
    numbers: dict[bytes, int] = {}
    names = sorted({name for name, _ in items})
    at = {name: k for k, name in enumerate(names)}
    texts = [(at[name], array("I", [numbers.setdefault(w, len(numbers) + 1) for w in words(text)])) for name, text in items]
    nodes = sum((max(1, len(ids) - window + 1)) * min(window, len(ids)) for _, ids in texts)
    if nodes * NODE_BYTES > max_bytes:
        raise ValueError(f"windows of up to {nodes} words in all need up to {nodes * NODE_BYTES} bytes in every task; raise max_bytes if tasks have the memory")
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    size, of, who = array("I"), array("I"), array("I")
    for owner, ids in texts:
        n = min(window, len(ids))
        for i in range(len(ids) - n + 1 if n else 0):
            key = tuple(ids[i : i + n])
            k = machine.get(key, -1)
            if k < 0:
                k = len(size)
                machine.add_word(key, k)
                size.append(n)
            of.append(k)
            who.append(owner)
    if len(size):
        machine.make_automaton()
    pair = np.unique(np.array(of, dtype=np.int64) * max(1, len(names)) + np.array(who, dtype=np.int64))
    first = np.searchsorted(pair, np.arange(len(size) + 1) * max(1, len(names)))
    return Windows(numbers, names, machine if len(size) else None, np.array(size, dtype=np.int64), first, pair % max(1, len(names)))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    min_share: tuple[int, int] = (1, 20),
    keep=None,
    max_bytes: int = 512 << 20,
    only_clean: bool = False,
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (their ids as sorted strings), hits
    (code-point spans of runs of hit words) and contaminated: some word is hit and the
    hit words are at least min_share of all.

    Null, empty and wordless texts have no words and are clean. Items that are null
    or wordless match nothing; rows of items that share an id count as one item, and
    equal windows of different items report all of them. Repeated documents are
    judged one by one. Columns of docs that clash with the results are replaced.
    only_clean leaves contaminated rows out and adds no columns. Items whose texts or
    automaton could need more than max_bytes raise ValueError before anything is built.
    """
    shared = share(docs.sparkSession, build(load_items(items, item_col, item_text, max_bytes), window, max_bytes))
    over, under = min_share
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hits", T.ArrayType(span)),
        T.StructField("contaminated", T.BooleanType()),
    ]

    def scan(column):
        windows = shared()
        vocabulary, labels, machine, sizes = windows.numbers, windows.names, windows.machine, windows.size
        texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
        ids, ranges, who = [], [[] for _ in texts], [set() for _ in texts]
        number = vocabulary.get
        for text in texts:
            ids.append(tuple([number(w, 0) for w in words(text)]))
        for d, sequence in enumerate(ids):
            if sequence and machine is not None:
                for end, k in machine.iter(sequence):
                    ranges[d].append((end - int(sizes[k]) + 1, end + 1))
                    who[d].add(k)
        n_hit, items_of, hits, bad = [], [], [], []
        for text, sequence, found, owners in zip(texts, ids, ranges, who, strict=True):
            runs = merged(found)
            n = sum(b - a for a, b in runs)
            n_hit.append(n)
            bad.append(n > 0 and under * n >= over * len(sequence))
            items_of.append(sorted({labels[o] for k in owners for o in windows.owners(k)}))
            at = []
            if runs and not only_clean:
                places = [m.span() for m in _WORD.finditer(text.translate(_LOWERED))]
                at = [
                    {"start": len(text[: places[a][0]].decode("utf-8", "replace")), "end": len(text[: places[b - 1][1]].decode("utf-8", "replace"))}
                    for a, b in runs
                ]
            hits.append(at)
        if only_clean:
            return [pa.array([not x for x in bad])]
        arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array([len(x) for x in items_of], pa.int64()),
            pa.array(items_of, pa.list_(pa.string())),
            pa.array(hits, arrow_span),
            pa.array(bad, pa.bool_()),
        ]

    if only_clean:
        return map_text(docs, text_col, keep, [], scan, rows_too=True)
    return map_text(docs, text_col, keep, fields, scan)


def items_digest(items_col: str = "items"):
    """Lower-case hex SHA-256 of the item ids, comma-joined."""
    return F.sha2(F.array_join(F.col(items_col), ","), 256)

"""Shards of near-equal bytes: a minimax contiguous partition of atomic groups.

Groups are equal texts, ordered by digest. A group larger than an even share of what is
left has a shard of its own (the last shards), so that the others still share evenly. For
these the smallest capacity that lets a greedy walk cut the ordered group sizes into the
shards that are left is found by binary search: the largest shard is as small as any
contiguous partition can make it. Cuts then lie as evenly as that capacity allows.

The walk sees the sizes of digest ranges. A range that a cut may fall into is split
into finer ranges, down to single groups, until the capacity and all cuts are exact:
the driver holds a few thousand ranges at most, however many groups there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .ordinals import positions

FIRST, FINER = 3, 2  # hexadecimal digits of the first ranges, and added by each split
SPLIT = 64  # ranges split in one round where the cuts do not say which


def walk(ends: np.ndarray, single: np.ndarray, capacity: int, most: int, sure: bool) -> tuple[int, list[int]]:
    """Shards of a greedy walk (more than `most` if it fails), and the ranges at which
    they begin, but for the first. With `sure`, ranges of several groups are kept
    whole, which can only need more shards; without, they are divided at will, which
    needs fewer."""
    total, at, shards, cuts = int(ends[-1]), 0, 0, []
    while at < total and shards <= most:
        shards += 1
        j = int(np.searchsorted(ends, at + capacity, side="right"))  # the first range that doesn't fit
        if j >= len(ends):
            break
        begin = int(ends[j - 1]) if j else 0
        if begin > at:
            at = begin if single[j] or sure else at + capacity
        elif single[j]:  # a group above the capacity: alone in a shard
            at = int(ends[j])
        elif sure:
            return most + 1, cuts
        else:  # several groups above the capacity in sum: passed for nothing
            at = int(ends[j])
            shards -= 1
        cuts.append(int(np.searchsorted(ends, at, side="right")))
    return shards, [c for c in cuts if c < len(ends)]


def search(sizes: np.ndarray, single: np.ndarray, shards: int) -> tuple[int, list[int], set[int]]:
    """Smallest capacity known to do, its cuts, and the ranges to split before it is
    known that no smaller one does."""
    ends = np.cumsum(sizes)

    def least(sure: bool, high: int) -> int:
        low = 0
        while high - low > 1:
            middle = (low + high) // 2
            if walk(ends, single, middle, shards, sure)[0] <= shards:
                high = middle
            else:
                low = middle
        return high

    best = least(True, int(ends[-1]))
    bound = least(False, best)  # no smaller capacity can do
    cuts = walk(ends, single, best, shards, True)[1]
    if best == bound:
        return best, cuts, set()
    early, late = walk(ends, single, bound, shards, True)[1], walk(ends, single, best, shards, False)[1]
    between: set[int] = set()
    for k in range(max(len(early), len(late))):
        a = early[k] if k < len(early) else len(sizes) - 1
        b = late[k] if k < len(late) else len(sizes) - 1
        between.update(range(max(0, min(a, b) - 1), min(len(sizes), max(a, b) + 1)))
    found = {k for k in between if not single[k]}
    if not found:  # the largest of the others, a few at a time
        several = np.flatnonzero(~single)
        found = set(several[np.argsort(-sizes[several], kind="stable")[:SPLIT]].tolist())
    return best, cuts, found


def even_cuts(sizes: np.ndarray, capacity: int, shards: int, forward: list[int], backward: list[int]) -> list[int]:
    """Cuts within the capacity, each as near as can be to an even share of what is
    left: no later than the walk from the front allows, no earlier than the walk from
    the back."""
    n = len(sizes)
    if not n or sizes.max() > capacity:
        return forward
    ends = np.cumsum(sizes)
    earliest = sorted(n - c for c in backward)
    earliest = [0] * (shards - 1 - len(earliest)) + earliest
    cuts, at, total = [], 0, int(ends[-1])
    for k in range(shards - 1):
        last = int(np.searchsorted(ends, at + capacity, side="right"))
        ideal = at + (total - at) / (shards - k)
        near = int(np.searchsorted(ends, ideal))
        before = int(ends[near - 1]) if near else 0
        near += ideal - before > int(ends[min(near, n - 1)]) - ideal
        cut = min(max(near, earliest[k], cuts[-1] if cuts else 0), last)
        cuts.append(cut)
        at = int(ends[cut - 1]) if cut else 0
    return [c for c in cuts if 0 < c < n]


def heavy(rows: DataFrame, shards: int) -> list[str]:
    """Digests of the groups that are larger than an even share of what the larger ones
    leave, the largest first; fewer than `shards`, unless there are no others."""
    found: list[str] = []
    ranges = rows.groupBy(F.substring("digest", 1, FIRST).alias("prefix")).agg(F.sum("size").alias("size")).collect()
    left = sum(r.size for r in ranges)
    known: dict[str, int] = {}  # the groups of ranges that were looked into, above the share of then
    while left and len(found) < shards:
        # groups above the share: in ranges above it, fewer than there are shards
        share = left / (shards - len(found))
        wide = [r.prefix for r in ranges if r.size > share]
        some = rows.where(F.substring("digest", 1, FIRST).isin(wide)) if wide else rows.limit(0)
        sizes = some.groupBy("digest").agg(F.sum("size").alias("size")).where(F.col("size") > share)
        known = {r.digest: r.size for r in sizes.collect()} if wide else {}
        more = sorted((d for d in known if d not in found), key=lambda d: (-known[d], d))
        if not more:
            break
        found += more
        left -= sum(known[d] for d in more)
    return found


def boundaries(rows: DataFrame, shards: int) -> list[str]:
    """Digest prefixes at which a new shard begins."""

    def ranges(df: DataFrame, digits: int) -> dict[str, tuple[int, bool]]:
        found = df.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.min("digest").alias("a"), F.max("digest").alias("b"))
        return {r.prefix: (r.size, r.a == r.b) for r in found.collect()}

    known = ranges(rows, FIRST)
    if not known:
        return []
    while True:
        prefixes = sorted(known)
        sizes = np.array([known[p][0] for p in prefixes], dtype=np.int64)
        single = np.array([known[p][1] for p in prefixes])
        capacity, cuts, split = search(sizes, single, shards)
        _, back, split_back = search(sizes[::-1], single[::-1], shards)
        split |= {len(sizes) - 1 - k for k in split_back}
        if not split:
            return [prefixes[c] for c in even_cuts(sizes, capacity, shards, cuts, back)]
        by_length: dict[int, list[str]] = {}
        for k in split:
            by_length.setdefault(len(prefixes[k]), []).append(prefixes[k])
        for digits, names in by_length.items():
            known |= ranges(rows.where(F.substring("digest", 1, digits).isin(names)), digits + FINER)
            for name in names:
                del known[name]


def shard(docs: DataFrame, shards: int = 24, text_col: str = "text", order_col: str = "doc_id", keep=None, overhead: int = 8) -> DataFrame:
    """docs with size (UTF-8 bytes plus overhead), text_crc32, law ("bytes"), shard
    and slot (gapless from 0 in its shard, by digest and order_col).

    Equal texts share a shard; null and empty texts count as equal, of no bytes and
    CRC 0. With fewer groups than shards some shards are empty. Repeated rows each
    have a slot. Columns of docs named like the results are replaced.
    """
    made = ["size", "text_crc32", "law", "shard", "slot"]
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = durable(
        docs.select(
            *[F.col(f"`{c}`").alias(f"keep_{c}") for c in names],
            F.col(order_col).alias("__order"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("digest"),
        )
    )
    alone = heavy(rows, shards)
    others = shards - len(alone)
    cuts = sorted(boundaries(rows.where(~F.col("digest").isin(alone)), others)) if others else []
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("digest") >= cut).cast("int")
    for k, digest in enumerate(alone):
        number = F.when(F.col("digest") == digest, F.lit(others + k)).otherwise(number)
    placed = rows.withColumn("law", F.lit("bytes")).withColumn("shard", number)
    return positions(placed, "shard", ["digest", "__order"]).select(*[F.col(f"`keep_{c}`").alias(c) for c in names], *made)

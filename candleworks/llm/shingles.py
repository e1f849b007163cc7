"""Near-duplicates by the exact Jaccard similarity of word shingles.

Texts with equal sets of shingles collapse first. Each set has a SimHash fingerprint, the
bitwise majority of its shingles' hashes; the BK-tree shards of `simhash` link those at two
or fewer differing bits, and two partners of each are compared exactly. Sets at the
similarity may lie a dozen bits apart, so a second search follows that misses none, and
compares only what fingerprints have not connected. Two sets at the similarity or above
share a shingle among the first size - ceil(similarity * size) + 1 of each in any one
order of all shingles, so every set goes to the groups of those, which are dealt by range
and may spread over tasks, and pairs whose sizes and shared first shingles leave room for
the overlap are compared exactly, again two partners of each first, then the pairs that
these do not connect. The order puts shingles that are frequent in a sample last; it
decides how many pairs are compared, not which are found. The sample is a share of the
texts, so what it does not know is as rare in a large corpus as in a small one. Groups with
more than `lags` others within reach, or in two tasks, wait until the links of the rest are
known, and then compare, in blocks, only sets that these do not connect and that are in
enough such groups. Whole sets travel only for pairs whose counts by bucket of the hash
leave room for the overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import LOWER, SPACE, bitmap_of, durable, hash_spans, in_bitmap, join_each, map_text, mix64, release, slices, spans_of, text_column, utf8
from .components import components

SIZE = 5
SIMILARITY = 0.8
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Least share of the texts whose shingles are counted, and the most shingles held as frequent.
SAMPLED, FREQUENT = 1 / 32, 1 << 21
_PAIR = "a long, b long, token long, size int, place int, room int, wide boolean"


def shingle_sets(column, size: int = SIZE):
    """The rising distinct shingle hashes of each text; fewer words than `size` are one
    shingle, no words none."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        starts, ends, doc = spans_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACE)
        words = hash_spans(data[offsets[i] : offsets[j]], starts, ends, LOWER)
        edge = np.searchsorted(doc, np.arange(j - i + 1))
        joined = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        for k in range(size):
            joined = joined * _STEP + words[k : k + len(joined)]
        joined = mix64(joined)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(joined[a : b - size + 1])
            else:
                yield np.array([xxhash.xxh64_intdigest(words[a:b].tobytes())] if b > a else [], dtype=np.uint64)


def node_of(values: np.ndarray) -> int:
    """Key of a set: 64 bits of its hash, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes(), 7)).view(np.int64))


def needed(similarity: float, n):
    """Least whole overlap that reaches similarity * n."""
    return np.ceil(similarity * np.asarray(n) - 1e-9).astype(np.int64)


def possible(similarity: float, size_a, place_a, size_b, place_b):
    """Whether sets that meet first at these places can overlap enough."""
    want = needed(similarity / (1 + similarity), size_a + size_b)
    return np.minimum(size_a - place_a, size_b - place_b) >= want


def least_shared(similarity: float, size_a, size_b):
    """Fewest first shingles that two sets at the similarity share: whichever's first ones
    end earlier in the order, only the rest of it can be shared beside them."""
    want = needed(similarity / (1 + similarity), size_a + size_b)
    return want - np.maximum(needed(similarity, size_a), needed(similarity, size_b)) + 1


def counts_of(values: np.ndarray) -> bytes:
    """How many of a set fall in each bucket of the hash, a byte each: one or two on
    average. Empty if a count is above 255."""
    m = 8
    while 2 * m < len(values):
        m *= 2
    n = np.bincount((values & np.uint64(m - 1)).astype(np.int64), minlength=m)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def shared_at_most(x: bytes, y: bytes) -> tuple[int, int]:
    """From counts_of two sets: a bound of how many they share, and how many they have."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    if not len(x) or not len(y):
        return 1, 1
    m = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, m).sum(axis=0), y.reshape(-1, m).sum(axis=0)).sum()), int(x.sum() + y.sum())


def shared(x: bytes, y: bytes) -> tuple[int, int]:
    """How many elements two sets share, and how many they have."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    return len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)


def _table(a, b=None, token=None, size=None, place=None, room=None, wide=None):
    def column(values, kind):
        return pa.nulls(len(a), kind) if values is None else pa.array(np.asarray(values), kind)

    columns = [column(a, pa.int64()), column(b, pa.int64()), column(token, pa.int64()), *[column(c, pa.int32()) for c in (size, place, room)], column(wide, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "token", "size", "place", "room", "wide"])


def _rows(batches, names):
    return (np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in names]) for batch in batches if batch.num_rows)


def _near(similarity: float, lags: int):
    """From rows (token, size, node, place) sorted in this order: pairs of rows that lie up
    to `lags` apart in their token (a quarter of that in wide ones), once for each token, with both sizes as size and place
    and the most that they can share from there as room; and the rows of the tokens that
    have more than `lags` others within reach of one. Tokens at the ends of what a task
    reads may go on in another task: all their rows are given too. No more rows are held
    than a batch and the lags before it."""

    def run(batches):
        held, done, last, wide, first = np.empty((0, 4), dtype=np.int64), 0, None, False, True
        open_rows: list[np.ndarray] = []  # of the last token, given once it is known to be wide
        for rows in _rows(batches, ("token", "size", "node", "place")):
            rows = np.concatenate([held, rows])
            same = np.concatenate([[False], (rows[1:, [0, 2]] == rows[:-1, [0, 2]]).all(axis=1)])
            rows = rows[~same]
            fresh = np.arange(len(rows)) >= done
            token, size, node, place = rows.T
            wide_ones, pairs = set(), []
            at = np.arange(len(rows))
            for lag in range(1, lags + 2):
                at = at[: np.searchsorted(at, len(rows) - lag)]
                at = at[(token[at] == token[at + lag]) & (needed(similarity, size[at + lag]) <= size[at])]
                if not len(at):
                    break
                now = at[fresh[at + lag]]
                if lag > lags:
                    wide_ones |= set(token[now].tolist())
                    break
                pairs.append((now, now + lag))
            if first:
                wide_ones.add(int(token[0]))
            if wide and last is not None:
                wide_ones.add(last)
            is_wide = np.isin(token, np.array(sorted(wide_ones), dtype=np.int64))
            # rows of wide tokens meet again once links are known: nearer ones do here
            pairs = [(i, j) if lag < lags // 4 else (i[~is_wide[i]], j[~is_wide[i]]) for lag, (i, j) in enumerate(pairs)]
            i, j = (np.concatenate([p[k] for p in pairs] or [[]]).astype(np.int64) for k in (0, 1))
            if len(i):
                swap = node[i] > node[j]
                a, b = np.where(swap, j, i), np.where(swap, i, j)
                yield _table(node[a], node[b], token[a], size[a], size[b], np.minimum(size[a] - place[a], size[b] - place[b]), is_wide[a])
            # rows of tokens that end in this batch are given if wide; the last token waits
            tail = token == token[-1]
            if open_rows and last != token[-1]:
                if last in wide_ones:
                    for part in open_rows:
                        yield _wide(part)
                open_rows = []
            given = is_wide & ~tail & fresh
            if given.any():
                yield _wide(rows[given])
            new = rows[tail & fresh]
            wide = bool(is_wide[-1])
            if wide:
                for part in [*open_rows, new]:
                    if len(part):
                        yield _wide(part)
                open_rows = []
            elif len(new):
                open_rows.append(new)
            first, last = False, int(token[-1])
            held = rows[max(0, len(rows) - lags - 1) :]
            held = held[held[:, 0] == last]
            done = len(held)
        for part in open_rows:  # the last token may go on elsewhere
            yield _wide(part)

    return run


def _wide(rows: np.ndarray):
    return _table(rows[:, 2], None, rows[:, 0], rows[:, 1], rows[:, 3], None, np.ones(len(rows), bool))


def _apart(similarity: float):
    """Candidate pairs of rows (token, i, j, block, node, size, place, root, held), sorted by
    the first three, whose roots differ: within a block where i = j, else of blocks i and j.
    held is how many wide groups a set is in from this one on: a pair that must share more
    first shingles than that met before, in another group, or is none."""

    def candidates(left, right):
        for node, size, place, root, held in left:
            rest = right[right[:, 3] != root]
            rest = rest[possible(similarity, size, place, rest[:, 1], rest[:, 2])]
            rest = rest[np.minimum(held, rest[:, 4]) >= least_shared(similarity, size, rest[:, 1])]
            if len(rest):
                yield _table(np.full(len(rest), node), rest[:, 0])

    def group(rows):
        i, j, block, rest = rows[0, 1], rows[0, 2], rows[:, 3], rows[:, 4:]
        if i != j:
            if not (rest[0, 3] == rest[:, 3]).all():
                yield from candidates(rest[block == i], rest[block == j])
            return
        _, which, n = np.unique(rest[:, 3], return_inverse=True, return_counts=True)
        if len(n) == 1:
            return
        rank = np.argsort(np.argsort(n, kind="stable"))[which]  # the largest class last
        rest, rank = rest[np.argsort(rank, kind="stable")], np.sort(rank)
        for k in np.flatnonzero(rank < rank[-1]):
            yield from candidates(rest[k : k + 1], rest[np.searchsorted(rank, rank[k], side="right") :])

    def run(batches):
        left: list[np.ndarray] = []  # rows of one token and pair of blocks, a bounded number
        for rows in _rows(batches, ("token", "i", "j", "block", "node", "size", "place", "root", "held")):
            edge = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1), [True]]))
            for a, b in zip(edge, edge[1:], strict=False):
                if left and (left[0][0, :3] != rows[a, :3]).any():
                    yield from group(np.concatenate(left))
                    left = []
                left.append(rows[a:b])
        if left:
            yield from group(np.concatenate(left))

    return run


def counted(found: DataFrame, wide: DataFrame | None, similarity: float) -> DataFrame:
    """Pairs whose first shingles leave room for the overlap. Whichever set's first ones
    end earlier in the order, what it shares up to there is counted, and the rest of it
    bounds what may follow. Nor can a pair share more than what is left from the first
    shingle it was met at, and what it shares before. In wide groups a pair may not have
    been met: there it shares at most as many as either set is in, met ones included."""
    pairs = found.where("b is not null")
    pairs = pairs.groupBy("a", "b", F.col("size").alias("size_a"), F.col("place").alias("size_b")).agg(F.count_if(~F.col("wide")).alias("shared"), F.count_if("wide").alias("met"), F.max("room").alias("room"))
    if wide is not None:
        open_ones = wide.groupBy("node").agg(F.count("*").alias("n"))
        pairs = pairs.join(open_ones.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a", "left").join(open_ones.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b", "left")
        pairs = pairs.withColumn("both", F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))))
        pairs = pairs.withColumns({"shared": F.col("shared") + F.col("both"), "room": F.col("room") + F.col("both") - F.col("met")})
    least = lambda share, n: F.ceil(n * F.lit(share) - 1e-9)
    want = least(similarity / (1 + similarity), F.col("size_a") + F.col("size_b"))
    later = F.greatest(*[least(similarity, F.col(c)) - 1 for c in ("size_a", "size_b")])
    return pairs.where((F.col("shared") + later >= want) & (F.col("room") >= want)).select("a", "b")


def _of_ends(pairs: DataFrame, texts: DataFrame, size: int, made) -> DataFrame:
    """(node, values) with made(set) for the sets that the pairs ask for, made where the
    texts are, and found by a bitmap of their keys."""
    wanted = bitmap_of(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())
    bitmap = texts.sparkSession.sparkContext.broadcast(wanted.tobytes())

    def run(batches):
        bits, seen = np.frombuffer(bitmap.value, dtype=np.uint8), set()
        for batch in batches:
            nodes, values = [], []
            for s in shingle_sets(batch.column("__text"), size):
                node = node_of(s)
                if node in seen or not in_bitmap(bits, np.array([node]))[0]:
                    continue
                seen.add(node)
                nodes.append(node)
                values.append(made(s))
                if len(nodes) == 200:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(values, pa.binary())], names=["node", "values"])
                    nodes, values = [], []
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(values, pa.binary())], names=["node", "values"])

    return durable(texts.mapInArrow(run, "node long, values binary").groupBy("node").agg(F.first("values").alias("values")))


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets whose exact similarity is high enough. Counts by bucket
    are compared first; whole sets are made and sent for those alone that may be."""
    pairs = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for made, overlap in ((counts_of, shared_at_most), (np.ndarray.tobytes, shared)):
        if pairs.isEmpty():
            break

        def compare(batches, overlap=overlap):
            for batch in batches:
                met = (overlap(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True))
                yield batch.select(["a", "b"]).filter(pa.array([both >= needed(similarity, n - both) for both, n in met], pa.bool_()))

        of = _of_ends(pairs, texts, size, made)
        ends = pairs.join(of.select(F.col("node").alias("a"), F.col("values").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("values").alias("y")), "b")
        good = durable(ends.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))
        release(pairs, of)
        pairs = good
    return pairs


def by_fingerprint(nodes: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) of the `total` sets (node, fingerprint): sets of equal fingerprints
    with the least of them, and those of the links that BK-tree shards find between
    fingerprints."""
    first = durable(nodes.groupBy("fingerprint").agg(F.min("node").alias("first"), F.count("*").alias("rows")))
    equal = join_each(nodes.select("node", "fingerprint"), first, "fingerprint", "rows", total).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = simhash.links(first.select("fingerprint"))
    for end in ("a", "b"):
        pairs = pairs.join(first.select(F.col("fingerprint").alias(end), F.col("first").alias(f"node_{end}")), end)
    found = durable(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).union(equal))
    release(first)
    return found


def two_of_each(pairs: DataFrame) -> DataFrame:
    """The pairs of each b with its least and its greatest a."""
    return pairs.groupBy("b").agg(F.min("a").alias("x"), F.max("a").alias("y")).select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), "b")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends have different roots."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) once the links are added to what has roots already."""
    if roots is None:
        return durable(components(links))
    if links.isEmpty():
        return roots
    more = durable(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)))
    release(roots)
    return more


def frequencies(texts: DataFrame, size: int, share: float, most: int = FREQUENT) -> np.ndarray:
    """A byte for each bucket of shingle hashes, a power of two of them: 16 times log2 of
    the most often that one of its shingles occurs in this share of the distinct texts, 0
    where none is held. Held are those that occur twice, and of more than `most` the most
    frequent."""

    def shingled(batches):
        for batch in batches:
            for s in shingle_sets(batch.column("__text"), size):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["token"])

    some = texts.where(F.pmod(F.xxhash64("__text"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).distinct()
    level = F.least(F.floor(16 * F.log2("n")), F.lit(255)).cast("short").alias("level")
    often = durable(some.mapInArrow(shingled, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token", level))
    held, least = 0, 256
    for row in often.groupBy("level").count().orderBy(F.desc("level")).collect():  # 256 at most
        if held + row["count"] > most:
            break
        held, least = held + row["count"], row["level"]
    buckets = 1 << 15
    while buckets < 8 * held:
        buckets *= 2
    at = F.col("token").bitwiseAND(F.lit(buckets - 1)).cast("int").alias("at")
    table = often.where(F.col("level") >= least).groupBy(at).agg(F.max("level").alias("level")).toArrow()
    out = np.zeros(buckets, dtype=np.uint8)
    out[table.column("at").to_numpy()] = table.column("level").to_numpy()
    release(often)
    return out


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep=None, size: int = SIZE, similarity: float = SIMILARITY, lags: int = 64, sample: int = 8192, block: int = 4096) -> DataFrame:
    """docs with component_id: the smallest id reachable over texts whose sets of word
    shingles have the Jaccard similarity or more, the row's own included.

    Null, empty and wordless texts link with each other. A null id is never a
    component's smallest; a component of null ids has a null one. Repeated rows stay as
    they are. A column of docs named component_id is replaced. Texts are read anew by
    each step and not copied; only rows whose text may be in a group are shuffled.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != "component_id"]
    body = f"keep_{text_col}" if text_col in names and docs.schema[text_col].dataType == T.StringType() else "body"
    apart = [] if body != "body" else [F.col(text_col).cast("string").alias("body")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"keep_{c}") for c in names], F.col(id_col).alias("__id"), *apart)
    texts = docs.select(text_column(text_col))

    def key(column):
        known = np.array([(node_of(s), simhash.signed(simhash.majority(s))) for s in shingle_sets(column, size)], dtype=np.int64)
        return [pa.array(known[:, 0]), pa.array(known[:, 1])]

    node = [T.StructField("node", T.LongType())]
    keyed = map_text(docs.select(F.col(id_col).alias("__id"), text_column(text_col)), "__text", ["__id"], [*node, T.StructField("fingerprint", T.LongType())], key)
    nodes = durable(keyed.groupBy("node").agg(F.min("__id").alias("least"), F.count("*").alias("rows"), F.first("fingerprint").alias("fingerprint")))
    n_nodes, total = nodes.agg(F.count("*"), F.sum("rows")).first()
    near = by_fingerprint(nodes, n_nodes)
    links = verified(two_of_each(near), texts, size, similarity)
    roots = _joined(None, links)
    release(near, links)
    share = min(1.0, max(SAMPLED, sample / max(1, n_nodes)))
    frequent = texts.sparkSession.sparkContext.broadcast(frequencies(texts, size, share).tobytes())

    def first_ones(batches):
        often = np.frombuffer(frequent.value, dtype=np.uint8)
        seen = set()

        def table(out):
            token, who, long, place = np.concatenate(out).T
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(who), pa.array(long.astype(np.int32)), pa.array(place.astype(np.int32))], names=["token", "node", "size", "place"])

        for batch in batches:
            out, rows = [], 0
            for values in shingle_sets(batch.column("__text"), size):
                who = node_of(values)
                if not len(values) or who in seen:
                    continue
                seen.add(who)
                values = values[np.argsort(often[(values & np.uint64(len(often) - 1)).astype(np.int64)], kind="stable")]
                first = values[: len(values) - int(needed(similarity, len(values))) + 1]
                out.append(np.column_stack([first.view(np.int64), np.full(len(first), who), np.full(len(first), len(values)), np.arange(len(first))]))
                rows += len(first)
                if rows > 50_000:
                    yield table(out)
                    out, rows = [], 0
            if out:
                yield table(out)
            if len(seen) > 500_000:
                seen.clear()

    tokens = texts.mapInArrow(first_ones, "token long, node long, size int, place int")
    found = durable(tokens.repartitionByRange("token", "size", "node").sortWithinPartitions("token", "size", "node", "place").mapInArrow(_near(similarity, lags), _PAIR))
    wide = durable(found.where("b is null").select("token", F.col("a").alias("node"), "size", "place").distinct())
    some_wide = not wide.isEmpty()
    pairs = durable(counted(found, wide if some_wide else None, similarity))
    # two partners of each first; what their links connect need not be compared
    links = verified(two_of_each(_between(pairs, roots)), texts, size, similarity)
    roots = _joined(roots, links)
    more = verified(_between(pairs, roots), texts, size, similarity)
    roots = _joined(roots, more)
    release(links, more, pairs)
    if some_wide:
        held = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("place")))
        rooted = wide.withColumn("held", held).join(roots, "node", "left").select("token", "node", "size", "place", F.coalesce("root", "node").alias("root"), "held")
        many = wide.groupBy("token").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        cut = rooted.join(many, "token").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        more = cut.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_apart(similarity), _PAIR)
        roots = _joined(roots, verified(more, texts, size, similarity))
    release(found, wide)
    of = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("in_all"))
    groups = durable(of.join(least, "root").where("in_all > 1").select("node", "component_id", "rows"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(groups.select(F.col("node").alias("key"))).tobytes())

    def grouped(column):
        at = np.array([node_of(s) for s in shingle_sets(column, size)], dtype=np.int64)
        return [pa.array(at), pa.array(in_bitmap(np.frombuffer(shared.value, dtype=np.uint8), at))]

    marked = map_text(rows, body, None, [*node, T.StructField("maybe", T.BooleanType())], grouped)
    own = F.when(F.col("in_group"), F.col("component_id")).otherwise(F.col("__id")).alias("component_id")
    columns = [F.col(f"`keep_{c}`").alias(c) for c in names]
    return placed(marked.where("maybe"), groups, total or 0).select(*columns, own).union(marked.where("not maybe").select(*columns, F.col("__id").alias("component_id")))


def placed(rows: DataFrame, groups: DataFrame, total: int, most: int = 100_000) -> DataFrame:
    """rows with the component_id and in_group of their node's group, null for those in
    none. Groups of more than 1/1000 of all rows, at most 1000, are broadcast."""
    known = groups.withColumn("in_group", F.lit(True))
    if total <= most:
        return rows.join(known.drop("rows"), "node", "left")
    hot = known.where(F.col("rows") > max(total // 1000, most // 100)).drop("rows")
    cold = known.where(F.col("rows") <= max(total // 1000, most // 100)).drop("rows")
    met = rows.join(F.broadcast(hot), "node", "left")
    rest = met.where(F.col("in_group").isNull()).drop("component_id", "in_group").join(cold, "node", "left")
    return met.where("in_group").unionByName(rest)


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those whose component has a smaller id. Repeated rows of the
    smallest id stay, as do rows without an id that link with none that has one."""
    found = near_duplicates(docs, text_col, id_col, **options)
    kept = found.where(F.col("component_id").isNull() | (F.col("component_id") == F.col(id_col)))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

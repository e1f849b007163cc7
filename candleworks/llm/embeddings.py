"""Near-duplicate vectors by product quantisation, with exact reranking.

Equal vectors (by two 64-bit hashes) collapse into one with a multiplicity. Coarse centroids and residual
subspace codebooks are fitted on a bounded sample; every vector then has a home list,
a code of its residual and the length of what the code leaves out. A vector probes all
lists whose cells come within a margin of it. Between two partners lies the plane that
parts their cells, and the nearer is away from it by at most half of how far they lie
apart across it. The margin is `reach` times the spread of that, which the sample's
residuals show across the planes of near lists (the 99th percentile of the planes), for
partners just at the similarity; half their whole distance, which no pair exceeds, is
its bound, reached where vectors vary in few directions. In a list, table look-ups give
asymmetric distances to all members; those that the code's error cannot rule out are
reranked by exact cosine. A pair is linked if either probes the other's list, and counted
once. Probes and candidates have no cap.

Lists are dealt to tasks in blocks of members and blocks of queries of at most `block`
rows, so a list that holds a third of all vectors is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_each, release, share
from .components import components


#: Doubles in one table of distances between rows and lists.
CELLS = 1 << 22

#: Margin in spreads: a pair is missed only where its vectors lie more than four spreads
#: apart across a plane that is about midway between them. Infinite: none is missed.
REACH = 2.0

#: Bytes of the vectors, as doubles, that the index is fitted on.
SAMPLE_BYTES = 256 << 20


@dataclass
class Index:
    centroids: np.ndarray  # lists x width
    codebooks: list[np.ndarray]  # for each subspace: codes x its width
    bounds: np.ndarray  # where subspaces begin
    margin: float

    @property
    def batch(self) -> int:
        """Rows that are compared with all lists at once: a few tables of CELLS doubles."""
        return max(16, CELLS // len(self.centroids))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Home list, codes, length of the coding error, and probed lists of unit rows."""
        d2 = np.maximum((x * x).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T, 0)
        home = d2.argmin(axis=1)
        rest = x - self.centroids[home]
        codes = np.empty((len(x), len(self.codebooks)), dtype=np.uint8)
        for j, book in enumerate(self.codebooks):
            part = rest[:, self.bounds[j] : self.bounds[j + 1]]
            codes[:, j] = ((book**2).sum(1) - 2 * part @ book.T).argmin(axis=1)
            rest[:, self.bounds[j] : self.bounds[j + 1]] -= book[codes[:, j]]
        return home, codes, np.sqrt((rest**2).sum(1)), self.probes(d2)

    def probes(self, d2: np.ndarray) -> list[np.ndarray]:
        """Lists to look into, the home included. The plane between the home's centroid
        and another bounds the other's cell; its distance is compared with the margin."""
        home = d2.argmin(axis=1)
        own, at = np.unique(home, return_inverse=True)
        squares = (self.centroids**2).sum(1)
        gaps = np.sqrt(np.maximum(squares[own][:, None] + squares - 2 * self.centroids[own] @ self.centroids.T, 0))
        near = d2 - d2[np.arange(len(d2)), home][:, None] <= 2 * gaps[at] * self.margin + 1e-6
        return [np.flatnonzero(n) for n in near]


def kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([((centres**2).sum(1) - 2 * x[i : i + 4096] @ centres.T).argmin(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def fit(sample: np.ndarray, lists: int, subspaces: int, codes: int, similarity: float, reach: float, seed: int = 5) -> Index:
    """Index of unit vectors, fitted on a sample of them."""
    rng = np.random.default_rng(seed)
    centroids = kmeans(sample, lists, 8, rng)
    home = np.concatenate([((centroids**2).sum(1) - 2 * sample[i : i + 4096] @ centroids.T).argmin(axis=1) for i in range(0, len(sample), 4096)])
    rest = sample - centroids[home]
    width = sample.shape[1]
    bounds = np.linspace(0, width, min(subspaces, width) + 1).astype(int)
    books = [kmeans(rest[:, a:b], codes, 6, rng) for a, b in zip(bounds, bounds[1:], strict=False)]
    apart = np.sqrt(max(0.0, 2 - 2 * similarity))
    return Index(centroids, books, bounds, min(apart / 2, reach * apart * spread(centroids, rest, rng)))


def spread(centroids: np.ndarray, rest: np.ndarray, rng, planes: int = 256, near: int = 8) -> float:
    """How much of a residual's length lies across the planes between near lists: root of
    the mean square, at the 99th percentile of some planes. 1 where nothing is known."""
    length = (rest**2).sum()
    if len(centroids) < 2 or length <= 0:
        return 1.0
    own = rng.choice(len(centroids), size=min(planes, len(centroids)), replace=False)
    d2 = ((centroids[own] ** 2).sum(1)[:, None] + (centroids**2).sum(1)) - 2 * centroids[own] @ centroids.T
    others = np.argsort(d2, axis=1)[:, 1 : near + 1]
    across = (centroids[others] - centroids[own][:, None]).reshape(-1, centroids.shape[1])
    norm = np.sqrt((across**2).sum(1))
    across = across[norm > 1e-9] / norm[norm > 1e-9][:, None]
    if not len(across):
        return 1.0
    shares = np.zeros(len(across))
    for i in range(0, len(rest), 4096):
        shares += ((rest[i : i + 4096] @ across.T) ** 2).sum(0)
    return float(np.sqrt(min(1.0, np.quantile(shares / length, 0.99))))


def unit_rows(raw: list[bytes], width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of doubles of width `width`, padded by zeros, and the widths they had."""
    size = np.dtype(kind).itemsize
    had = np.array([len(r) // size for r in raw], dtype=np.int64)
    x = np.zeros((len(raw), width))
    for i, r in enumerate(raw):
        x[i, : had[i]] = np.frombuffer(r, dtype=kind)
    top = np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    x /= np.where(top > 0, top, 1)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300), had


def packed(vectors: DataFrame, kind: str) -> DataFrame:
    """Arrays v of floats or doubles as little-endian bytes."""

    def run(batches):
        for batch in batches:
            column = batch.column("v").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n"), pa.array([np.asarray(v, dtype=kind).tobytes() for v in column], pa.binary())], names=["k", "n", "raw"])

    return vectors.mapInArrow(run, "k long, n long, raw binary")


def search_block(index: Index, home: int, members: dict, queries: dict, similarity: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Keys with their numbers of linked rows as far as this block counts them, and
    links that connect what all links of the block connect."""
    x, codes, error, lists = members["x"], members["codes"], members["error"], len(index.centroids)
    keys = np.unique(np.concatenate([members["k"], queries["k"]]))
    counts, label = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
    at_member, at_query = np.searchsorted(keys, members["k"]), np.searchsorted(keys, queries["k"])
    links = []
    for i in range(0, len(queries["k"]), 512):
        q = queries["x"][i : i + 512]
        dots = np.repeat((q @ index.centroids[home])[:, None], len(x), axis=1)
        for j, book in enumerate(index.codebooks):
            dots += (q[:, index.bounds[j] : index.bounds[j + 1]] @ book.T)[:, codes[:, j]]
        row, column = np.nonzero(dots + error >= similarity - 1e-6)
        other = (queries["k"][i + row] != members["k"][column]) & (queries["had"][i + row] == members["had"][column])
        row, column = row[other], column[other]
        exact = np.empty(len(row))
        for a in range(0, len(row), 1 << 16):
            exact[a : a + (1 << 16)] = np.einsum("ij,ij->i", q[row[a : a + (1 << 16)]], x[column[a : a + (1 << 16)]])
        good = exact >= similarity
        row, column = row[good], column[good]
        if not len(row):
            continue
        np.add.at(counts, at_query[i + row], members["n"][column])
        # the member counts the query here unless it meets it in the query's home list
        alone = ~np.isin(column * lists + queries["home"][i + row], members["probed"])
        np.add.at(counts, at_member[column[alone]], queries["n"][i + row[alone]])
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for a, b in zip(first, [*first[1:], len(row)], strict=True):
            me, partners = at_query[i + row[a]], at_member[column[a:b]]
            if (label[partners] == label[me]).all():
                continue
            joined, where = np.unique(label[partners], return_index=True)
            for c, w in zip(joined, where, strict=True):
                if c != label[me]:
                    links.append((int(keys[me]), int(keys[partners[w]])))
            merged = np.append(joined, label[me])
            label[np.isin(label, merged)] = merged.min()
    some = np.flatnonzero(counts)
    return keys[some], counts[some], links


def near_duplicates(vectors: DataFrame, similarity: float = 0.9, vector_col: str = "embedding", id_col: str = "vec_id", keep=None, per_list: int = 256, max_lists: int = 16_384, reach: float = REACH, subspaces: int = 16, codes: int = 256, block: int = 2048) -> DataFrame:
    """vectors with n_links (other rows at the similarity or above), component_id (the
    smallest id reachable by links, its own included) and kept (it is that id).

    Vectors that are null, empty, zero or hold a null, NaN or infinite component link
    with nothing, and vectors of different widths not with each other. Equal vectors
    all link. With reach infinite every pair is found. The index is fitted on about 16 distinct vectors a list (8192 at least, and
    16 * max_lists or SAMPLE_BYTES at most) chosen by hash, and covers all; max_lists bounds this fit on
    the driver, not what is found: with more vectors the lists grow, and the work in each
    with its square. Columns of vectors named like the results are replaced.
    """
    made = ["n_links", "component_id", "kept"]
    names = [c for c in (vectors.columns if keep is None else keep) if c.lower() not in made]
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    value = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    sound = F.coalesce(
        F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0), F.lit(False)
    )
    digest = F.concat_ws(":", F.xxhash64("__v"), F.xxhash64(F.lit(1), "__v"))
    rows = vectors.select(*[F.col(f"`{c}`").alias(f"keep_{c}") for c in names], F.col(id_col).alias("__id"), F.when(sound, value).alias("__v")).withColumn("__digest", digest)
    has, none = rows.where(F.col("__v").isNotNull()), rows.where(F.col("__v").isNull())
    classes = has.groupBy("__digest").agg(F.first("__v").alias("__v"), F.count("*").alias("n"), F.min("__id").alias("least"))
    classes = durable(classes.withColumn("k", F.monotonically_increasing_id()))
    n, width, total = classes.agg(F.count("*"), F.max(F.size("__v")), F.sum("n")).first()
    kept_columns = [F.col(f"`keep_{c}`").alias(c) for c in names]
    alone = none.select(*kept_columns, F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    raw = packed(classes.select("k", "n", F.col("__v").alias("v")), kind)
    most = max(1024, SAMPLE_BYTES // (8 * width))
    lists = int(np.clip(n // per_list, 1, min(max_lists, most // 4)))
    sample = min(max(16 * lists, 8192), most)
    part = min(1.0, sample / n)
    chosen = raw.where(F.pmod(F.xxhash64("raw"), F.lit(1 << 20)) < int(np.ceil(part * (1 << 20)))).select("raw").toArrow()
    train = unit_rows(chosen.column("raw").to_pylist(), width, kind)[0]
    if not len(train):  # few vectors, none in the share of the hash
        train = unit_rows([r.raw for r in raw.select("raw").limit(sample).collect()], width, kind)[0]
    index = share(vectors.sparkSession, fit(train, lists, subspaces, codes, similarity, reach))

    def deal(batches):
        """Rows for the lists: members (with code and probed lists) and queries (with
        their home)."""
        for batch in batches:
            blobs = batch.column("raw").to_pylist()
            x, _ = unit_rows(blobs, width, kind)
            k, count = batch.column("k").to_numpy(), batch.column("n").to_numpy()
            step = index().batch
            for i in range(0, len(x), step):
                home, code, error, probed = index().encode(x[i : i + step])
                of = np.repeat(np.arange(len(home)), [len(p) for p in probed])
                take = np.concatenate([np.arange(len(home)), of]) + i
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([home, *probed]).astype(np.int32)),
                        pa.array(np.arange(len(take)) >= len(home)),
                        pa.array(k[take]),
                        pa.array(count[take]),
                        pa.array([blobs[t] for t in take], pa.binary()),
                        pa.array([c.tobytes() for c in code] + [None] * len(of), pa.binary()),
                        pa.array(np.concatenate([error, np.zeros(len(of))]).astype(np.float32)),
                        pa.array([p.astype(np.int32) for p in probed] + [home[o : o + 1].astype(np.int32) for o in of], pa.list_(pa.int32())),
                    ],
                    names=["list", "query", "k", "n", "raw", "code", "error", "lists"],
                )

    columns = ["list", "query", "k", "n", "raw", "code", "error", "lists"]
    dealt = durable(raw.mapInArrow(deal, "list int, query boolean, k long, n long, raw binary, code binary, error float, lists array<int>"))
    sizes = dealt.groupBy("list").agg(F.ceil(F.count_if(~F.col("query")) / block).cast("int").alias("m"), F.ceil(F.count_if("query") / block).cast("int").alias("q"))
    own = F.pmod(F.xxhash64("k"), F.when(F.col("query"), F.col("q")).otherwise(F.col("m"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("query"), F.col("m")).otherwise(F.col("q")) - 1)
    spread_rows = dealt.join(F.broadcast(sizes), "list").where("m > 0 and q > 0").select(*columns, own.alias("own"), F.explode(others).alias("other"))
    spread_rows = spread_rows.withColumn("mb", F.when(F.col("query"), F.col("other")).otherwise(F.col("own"))).withColumn("qb", F.when(F.col("query"), F.col("own")).otherwise(F.col("other")))

    def compare(table: pa.Table) -> pa.Table:
        names = ["a", "b", "n"]
        query = table.column("query").to_numpy(zero_copy_only=False)
        if query.all() or not query.any():
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        k, count = table.column("k").to_numpy(), table.column("n").to_numpy()
        x, had = unit_rows(table.column("raw").to_pylist(), width, kind)
        code = [c for c in table.column("code").to_pylist() if c is not None]
        others = table.column("lists").combine_chunks()
        begin, others = others.offsets.to_numpy(), others.values.to_numpy()
        here, there = np.flatnonzero(~query), np.flatnonzero(query)
        members = {"k": k[here], "n": count[here], "x": x[here], "had": had[here], "error": table.column("error").to_numpy()[here] + 1e-6}
        size = begin[here + 1] - begin[here]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        members["probed"] = np.repeat(np.arange(len(here)), size) * len(index().centroids) + others[np.repeat(begin[here], size) + within]
        members["codes"] = np.frombuffer(b"".join(code), dtype=np.uint8).reshape(len(code), -1)
        queries = {"k": k[there], "n": count[there], "x": x[there], "had": had[there], "home": others[begin[there]].astype(np.int64)}
        who, counts, links = search_block(index(), int(table.column("list")[0].as_py()), members, queries, similarity)
        a = np.concatenate([who, np.array([p for p, _ in links], dtype=np.int64)])
        b = pa.array([None] * len(who) + [p for _, p in links], pa.int64())
        return pa.table([pa.array(a), b, pa.array(np.concatenate([counts, np.zeros(len(links), np.int64)]))], names=names)

    found = durable(spread_rows.groupBy("list", "mb", "qb").applyInArrow(compare, "a long, b long, n long"))
    release(dealt)
    roots = components(found.where("b is not null")).withColumnRenamed("node", "k")
    counted = found.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("linked"))
    of = classes.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    table = of.join(least, "root").join(counted, "k", "left").select("__digest", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id", "n")
    joined = join_each(has.drop("__v"), table, "__digest", "n", total)
    return joined.select(*kept_columns, "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("__id")).alias("kept")).union(alone)

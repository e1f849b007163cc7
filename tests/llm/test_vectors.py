"""Recall of vector links at cosine 0.9 exactly, with the production margin: for vectors
in few and in many directions, clustered or not, at several numbers of lists."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candleworks.llm import embeddings


def partners(x, rng, cosine=0.902):
    """A partner of each row in a random direction of the rows' own space."""
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


def vectors(kind, rng, n=1500):
    rank = int(kind.removeprefix("rank")) if kind.startswith("rank") else 64
    x = rng.normal(size=(n, rank))
    if kind == "clusters":
        x = rng.normal(size=(40, rank))[rng.integers(0, 40, n)] + x * 0.25
    if kind == "falling":
        x *= np.arange(1, rank + 1) ** -0.7
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = np.vstack([x, partners(x, rng)]) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T
    return u.astype(np.float32)


def linked(spark, u, **options):
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(u)), "embedding": pa.array(u.tolist(), pa.list_(pa.float32()))}))
    return embeddings.near_duplicates(table, **options).agg(F.sum("n_links")).first()[0]


def true_links(u):
    u = u.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cosine = u @ u.T
    assert not ((cosine > 0.9 - 1e-12) & (cosine < 0.9 + 1e-12)).any()
    return int((cosine >= 0.9).sum()) - len(u)


@pytest.mark.parametrize("kind", ["rank2", "rank4", "rank16", "rank64", "clusters", "falling"])
def test_recall_with_the_production_margin(spark, kind):
    u = vectors(kind, np.random.default_rng(7))
    true = true_links(u)
    assert 0.99 * true <= linked(spark, u, per_list=32) <= true


def test_no_pair_is_missed_with_an_infinite_reach(spark):
    u = vectors("falling", np.random.default_rng(8), 800)
    assert linked(spark, u, per_list=16, reach=float("inf")) == true_links(u)


@pytest.mark.parametrize("kind", ["rank4", "rank16", "rank64", "clusters", "falling"])
@pytest.mark.parametrize("lists", [16, 128, 512])
def test_probes_reach_partners(kind, lists):
    """Without Spark: either vector of a pair probes the other's list."""
    u = vectors(kind, np.random.default_rng(lists), 6000).astype(float)
    index = embeddings.fit(u, lists, 8, 16, 0.9, embeddings.REACH)
    home, probed = [], []
    for i in range(0, len(u), index.batch):
        h, _, _, p = index.encode(u[i : i + index.batch])
        home += h.tolist()
        probed += [set(x.tolist()) for x in p]
    n = len(u) // 2
    met = np.mean([home[i + n] in probed[i] or home[i] in probed[i + n] for i in range(n)])

    assert met >= (0.96 if (kind, lists) == ("clusters", 512) else 0.99)  # there, lists of a dozen vectors cut tight clusters up

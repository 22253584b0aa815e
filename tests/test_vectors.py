"""Nearest vectors by the index and by bundles, against all distances."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from metaweave.operators import pivots, vector


def rows(n=3000, dim=6):
    r = np.random.default_rng(3)
    centres = r.normal(0, 10, (12, dim))
    x = (centres[r.integers(0, 12, n)] + r.normal(0, 1, (n, dim))).astype(np.float32)
    x[100:140] = x[99]  # copies: ties by id
    return x


def plain(x, q, k, leave=None):
    far = np.sqrt(np.square(x.astype(np.float64) - np.asarray(q, np.float64)).sum(axis=1))
    at = [int(i) for i in np.lexsort((np.arange(len(x)), far)) if i != leave][:k]
    return [(i, round(float(far[i]), 9)) for i in at]


def test_pivot_index_is_exact_and_reads_few_files(spark, tmp_path, monkeypatch):
    x = rows()
    data = [(k, [float(c) for c in v], "a" if k % 3 else "b") for k, v in enumerate(x)]
    odd = [(9000, None, "a"), (9001, [], "a"), (9002, [1.0], "a")]
    d = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, org string")
    index = pivots.PivotIndex.build(d, f"file://{tmp_path}/i", 40, org_col="org")
    assert index.vectors().count() == len(x) and index.cells["n"].sum() == len(x)
    a = [k for k in range(len(x)) if k % 3]
    for q in (x[5], x[99], np.zeros(6), np.full(6, 1e3)):
        for k in (1, 7, 45):
            got = [(r.id, round(r.distance, 9)) for r in index.search([float(c) for c in q], k, "a").collect()]
            assert got == [(a[i], far) for i, far in plain(x[a], q, k)]
    assert len(index.search([0.0] * 6, 5000, "a").collect()) == len(a) and index.search([0.0] * 6, 3, "none").collect() == []
    assert index.reach([0.0] * 6, 10_000, "a") == math.inf
    near = index._nearest(np.asarray(x[5], np.float64), 3, "a", {3: (0.0, 5.0)})
    assert len(near.inputFiles()) == len(index.vectors().inputFiles()) and "PartitionFilters: [isnotnull(org" in near._jdf.queryExecution().executedPlan().toString()
    c, _ = index._plan(np.asarray(x[5], np.float64), 3, "a")
    kth = plain(x[a], x[5], 3)[-1][1]
    assert (c["near"] <= kth).sum() < len(c) / 3  # of an org's cells most aren't read
    monkeypatch.setattr(pivots, "MEET", 100)  # cells in parts
    some = d.filter("vec_id % 100 = 1 AND org = 'a'")
    got = {}
    for r in index.search_many(some, 4, org="a").collect():
        got.setdefault(r.query, []).append((r["rank"], r.id, round(r.distance, 9)))
    for q in (k for k in a if k % 100 == 1):
        assert sorted(got[q]) == [(n + 1, a[i], far) for n, (i, far) in enumerate(plain(x[a], x[q], 4, a.index(q)))]
    again = pivots.PivotIndex.open(spark, index.path)
    assert (again.pivots == index.pivots).all()
    none = pivots.PivotIndex.build(d.limit(0), f"file://{tmp_path}/j", 4)
    assert none.search([1.0], 3).collect() == [] and none.search_many(d.limit(0), 3).collect() == []


def test_bundles_are_as_near_as_their_nearest_vector(spark):
    r = random.Random(2)
    x = rows(600)
    bundles = [f"B{r.randrange(90)}" for _ in x]
    d = spark.createDataFrame([(b, [float(c) for c in v], f"o{k % 2}") for k, (b, v) in enumerate(zip(bundles, x))] + [("none", None, "o1"), ("short", [1.0], "o1")], "bundle string, embedding array<float>, org_id string").repartition(7)
    far = np.sqrt(np.square(x.astype(np.float64) - x[3].astype(np.float64)).sum(axis=1))
    for org in (None, "o1"):
        best = {}
        for k, b in enumerate(bundles):
            if org is None or k % 2:
                best[b] = min(best.get(b, math.inf), far[k])
        for k in (1, 8, 50):
            got = [(h.bundle, round(h.distance, 9)) for h in vector.search_bundles(d, [float(c) for c in x[3]], k, org=org).collect()]
            assert got == [(b, round(v, 9)) for v, b in sorted((v, b) for b, v in best.items())[:k]]
    assert vector.search_bundles(d, [0.0] * 6, 0).collect() == [] and vector.search_bundles(d.filter("bundle = 'none'"), [0.0] * 6, 3).collect() == []
    counts = vector.vector_counts(d.select("org_id", F.lit("h").alias("content_hash"))).collect()
    assert {(c.org_id, c.vectors, c.contents) for c in counts} == {("o0", 300, 1), ("o1", 302, 1)}


def test_texts_of_other_words_have_other_vectors(spark):
    names = [f"ApexClass: ApexClass:N{k}\n" for k in range(1, 1501)]
    v = np.array(vector.hashing_embedder()([*names, "b a", "a  B", "", None]), np.float32)
    assert len(np.unique(v[:1500], axis=0)) == 1500 and v.shape == (1504, 384)
    assert (v[1500] == v[1501]).all() and not v[1502:].any() and np.allclose(np.linalg.norm(v[:1501], axis=1), 1)
    assert np.array(vector.hashing_embedder(70)(["a"])).shape == (1, 70)
    # N1166, N205, N372 and N431, before N3 in order of name, had its vector
    d = spark.createDataFrame([(n.split()[1], x.tolist()) for n, x in zip(names, v)], "qname string, embedding array<float>")
    found = vector.knn(d, vector.hashing_embedder()(["ApexClass: ApexClass:N3"])[0], 2, "qname").collect()
    assert found[0].qname == "ApexClass:N3" and found[0].distance < 1e-6 and found[1].distance > 0.1

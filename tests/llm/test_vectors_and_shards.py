"""Clustering, whitening and sharding against plain loops, on odd rows and empty tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import clustering, queries, sharding, whitening


def plain_lloyd(rows, centroids, rounds):
    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in rows:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if groups[i] else c for i, c in enumerate(centroids)]
    return collections.Counter((i, near(v)[1], near(v)[0]) for i, v in rows), centroids


def clustered(rng, n, width, groups=6, spread=4):
    middles = [[rng.randint(-300, 300) for _ in range(width)] for _ in range(groups)]
    return [[m + rng.randint(-spread, spread) for m in rng.choice(middles)] for _ in range(n)]


@pytest.mark.parametrize("spread", [3, 400])
def test_dual_tree_equals_all_pairs(spread):
    rng = random.Random(spread)
    x = np.array(clustered(rng, 600, 8, spread=spread) + [[5] * 8] * 40 + [[2**26, -(2**26)] * 4] * 2)
    centroids = np.array([x[rng.randrange(640)] for _ in range(14)] + [[5] * 8, [5] * 8, [2**25] * 8])  # repeated ones too
    tree = clustering.CoverTree(x)
    points = x[tree.order]
    got, compared = clustering.nearest(points, tree, centroids, clustering.CoverTree(centroids, leaf=1))
    d = ((points[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    assert (got == d.argmin(1)).all()
    assert compared < d.size * (0.2 if spread == 3 else 1.01)  # most pairs are pruned where vectors lie in groups


def test_cover_tree_covers_and_separates():
    x = np.array(clustered(random.Random(5), 500, 4, spread=60))
    tree = clustering.CoverTree(x)
    assert sorted(tree.order) == list(range(500))
    p = x[tree.order]
    for node in range(len(tree.start)):
        inside = np.sqrt(((p[tree.start[node] : tree.end[node]] - p[tree.start[node]]) ** 2).sum(1))
        assert (inside <= tree.radius[node]).all()
        below = range(tree.first[node], tree.first[node] + tree.count[node])
        centres = p[[tree.start[c] for c in below]]
        for i in range(len(centres)):
            assert (((centres[i + 1 :] - centres[i]) ** 2).sum(1) > (tree.radius[node] / 2) ** 2 * 0.999).all()
        if len(centres):
            assert tree.start[below[0]] == tree.start[node] and tree.end[below[-1]] == tree.end[node]


def test_lloyd_equals_plain_loop(spark):
    rng = random.Random(2)
    vectors = clustered(rng, 300, 6, groups=4, spread=30)
    rows = [(i, v) for i, v in enumerate(vectors)] + [(7, vectors[7]), (7, vectors[8]), (None, vectors[9])] + [(1000 + i, [1] * 6) for i in range(60)]
    centroids = [vectors[3], vectors[3], [10_000] * 6, *vectors[10:15]]  # a tie and a cluster that stays empty
    df = spark.createDataFrame(rows, "vec_id long, v array<int>")
    found, final = clustering.lloyd(df, np.array(centroids), 3, block_rows=50)
    want, wanted = plain_lloyd(rows, centroids, 3)
    assert collections.Counter((r.vec_id, r.cluster, r.distance) for r in found.collect()) == want
    assert final.tolist() == wanted
    out = clustering.with_inertia(found, final).collect()
    assert {r.inertia for r in out} == {sum(d * n for (_, _, d), n in want.items())}
    assert all(r.cluster_inertia == sum(d * n for (_, c, d), n in want.items() if c == r.cluster) for r in out)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, wanted[r.cluster])).encode()).hexdigest() for r in out)


def test_op11_leaves_out_other_vectors(spark, tmp_path):
    good = [(i, [math.sin(i * j + 1) for j in range(64)]) for i in range(20)]
    bad = [(50, None), (51, [0.5] * 63), (52, [0.5] * 63 + [None]), (53, [float("nan")] * 64), (54, [float("inf")] * 64), (55, [])]
    rows = [(i, v, "a", "b", "c") for i, v in good + bad]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, v string, nth string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_clusters(spark, str(tmp_path))
    assert sorted(r.vec_id for r in got.collect()) == list(range(20))
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    for query in (queries.op11_clusters, queries.op12_whitening):
        empty = query(spark, f"{tmp_path}/none")
        assert empty.columns and empty.count() == 0
    assert empty.columns == queries.op12_whitening(spark, str(tmp_path)).columns


def plain_whitening(vectors, k):
    """Means and covariance in integers, over distinct vectors."""
    once = sorted(set(map(tuple, vectors)))
    n, sums = len(once), [sum(c) for c in zip(*once, strict=True)]
    apart = np.array([[n * x - s for x, s in zip(v, sums, strict=True)] for v in once], dtype=object)
    exact = apart.T.dot(apart)
    covariance = np.array([[float(e) / n / n / n for e in row] for row in exact])
    e, v = np.linalg.eigh(covariance)
    order = np.argsort(-e)[:k]
    return n, sums, e[order], v[:, order], covariance.trace()


def test_whitening_equals_plain_arithmetic(spark):
    rng = np.random.default_rng(4)
    x = [[int(e) for e in row] for row in np.floor(64 * (rng.normal(size=(120, 7)) @ rng.normal(size=(7, 7)) + 30)) + 1_000_000]
    rows = [(i, v) for i, v in enumerate(x)] + [(1000 + i, x[0]) for i in range(200)] + [(None, x[5]), (3, x[6])]  # a hot group of copies
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, x array<long>"), 5).collect()
    n, sums, e, v, trace = plain_whitening(x, 5)
    assert len(got) == 5 * len(rows) and {r.n for r in got} == {n} and got[0].identity_error < 1e-9
    held = {i: row for i, row in enumerate(x)} | {1000 + i: x[0] for i in range(200)} | {None: x[5]}
    by_component = collections.defaultdict(list)
    for r in got:
        if r.vec_id == 3:
            continue
        deviation = [n * a - s for a, s in zip(held[r.vec_id], sums, strict=True)]
        assert r.deviation == sum(d * d for d in deviation)
        want = float(np.array([d / n for d in deviation]) @ v[:, r.component - 1]) / math.sqrt(e[r.component - 1])
        by_component[r.component].append((r.whitened, want))
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)
    for pairs in by_component.values():
        sign = math.copysign(1, sum(a * b for a, b in pairs))
        assert all(a == pytest.approx(sign * b, abs=1e-8) for a, b in pairs)


def test_whitening_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, x string, whitened string, place string"
    rows = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 3.0, 0.5]), (3, [1.0]), (4, None), (5, [None, 1.0]), (6, [float("nan")]), (7, [3e38, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], schema)
    out = whitening.whiten(whitening.whole_vectors(df.where("vec_id < 7"))).collect()
    assert {r.vec_id for r in out} == {1, 2, 3} and len(out) == 9
    assert {r.component for r in out if r.whitened is None} == {3} and {r.explained for r in out if r.component == 3} == {0.0}
    assert whitening.whiten(whitening.whole_vectors(df)).where("deviation is null and whitened is not null").count() == 4  # beyond a long; one component varies
    single = whitening.whiten(whitening.whole_vectors(df.where("vec_id = 1"))).collect()
    assert [r.whitened for r in single] == [None] * 3 and {r.deviation for r in single} == {0} and {r.identity_error for r in single} == {None}


def test_hypergeometric_has_its_law():
    rng = np.random.default_rng(9)
    good, bad, n, tries = 7, 9, 6, 20000
    for direct in (10**9, 1):  # by numpy, and by thinning
        seen = collections.Counter(sharding.hypergeometric(rng, good, bad, n, direct) for _ in range(tries))
        for k in range(n + 1):
            p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
            assert seen[k] / tries == pytest.approx(p, abs=5 * math.sqrt(p * (1 - p) / tries) + 1e-9)
    draws = [sharding.hypergeometric(rng, 3 * 10**11, 7 * 10**11, 10**10) for _ in range(200)]
    assert np.mean(draws) == pytest.approx(3e9, abs=6 * math.sqrt(10**10 * 0.21 * 0.99 / 200))


def test_matrix_has_its_margins_and_law():
    blocks, columns = [3, 0, 5, 2], [4, 3, 3]
    seen = collections.Counter()
    for seed in range(4000):
        m = sharding.Matrix(blocks, columns, seed)
        rows = [m.row(i) for i in range(4)]
        assert [sum(r) for r in rows] == blocks and [sum(c) for c in zip(*rows, strict=True)] == columns
        seen[rows[0]] += 1
    for cell, count in seen.items():  # the first block's row has the multivariate hypergeometric law
        p = math.prod(math.comb(c, x) for c, x in zip(columns, cell, strict=True)) / math.comb(10, 3)
        assert count / 4000 == pytest.approx(p, abs=5 * math.sqrt(p / 4000))


def test_shards_hold_every_row_once(spark):
    rows = [(i % 300, None if i % 50 == 0 else "same" if i % 3 else f"text {i} ü", 5, "x", None) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int, at string, n string").repartition(7)
    out = sharding.shuffle(df, 16, seed=3, piece_rows=10, block_rows=64)
    assert out.columns == ["doc_id", "text", "at", "n", "shard", "slot"]
    got = out.collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((i, t) for i, t, *_ in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} == {62, 63}
    few = sharding.shuffle(df.limit(3), 16).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.shuffle(df.where("false"), 16).count() == 0


def test_shuffle_is_uniform(spark):
    """Each row is as likely in each place."""
    df = spark.range(0, 12, 1, 3)
    places = np.zeros((12, 12))
    tries = 36
    for seed in range(tries):
        for r in sharding.shuffle(df, 4, seed=seed, piece_rows=2, block_rows=2).collect():
            places[r.id, r.shard * 3 + r.slot] += 1
    expected = tries / 12
    chi = ((places - expected) ** 2 / expected).sum()
    assert chi < 121 + 5 * math.sqrt(2 * 121)


def test_written_shards_are_in_order(spark, tmp_path):
    df = spark.range(500).withColumn("text", F.col("id").cast("string"))
    dealt = sharding.shuffle(df, 3, piece_rows=50)
    sharding.write_shards(dealt, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 500 and {r.shard: r.n for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {0: 167, 1: 167, 2: 166}


def test_op13_digests(spark, tmp_path):
    texts = [None, "", "ünï", "ünï", "plain " * 2000]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_shards(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)

"""SimHash and cover-tree near-duplicates, and connected components, against brute force."""

import random
from collections import defaultdict
from itertools import combinations
from math import comb

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brindle.llm import simhash
from brindle.llm.common import stored
from brindle.llm.components import components, with_least
from brindle.llm.covertree import CoverTree, Groups, grouped, pairs
from brindle.llm.queries_simhash import op3_simhash_dedup
from brindle.llm.simhash import fingerprint, hexed, links, point, representatives

SPACES = " \t\n\x0b\x0c\r"


def brute_fingerprint(text):
    """Word by word and bit by bit, as the definition reads."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in SPACES else c for c in lowered).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(edges):
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {a: find(a) for a in root}


TEXTS = [None, "", " \n\t ", "One", "a b", "A B", "a b c", "É É É x", "é é é x", "a b　c d", "w " * 5000, " ".join(map(str, range(3000))), "\U0001F600 a b c"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_of_spark_hash(spark):
    """One shingle's fingerprint is its XXH64, which Spark computes as well."""
    got = spark.createDataFrame([("a b c",)], "t string").select(hexed(F.xxhash64("t")).alias("h")).first().h
    assert got == f"{fingerprint('a b c'):016x}"


def test_point_bounds_the_distance(spark):
    rng = random.Random(5)
    xs = [rng.getrandbits(64) for _ in range(300)]
    ys = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for x in xs]
    df = spark.createDataFrame([(simhash._signed(x), simhash._signed(y)) for x, y in zip(xs, ys, strict=True)], "x long, y long")
    got = df.select(F.bit_count(point(F.col("x")).bitwiseXOR(point(F.col("y")))).alias("d")).collect()

    def counts(v):
        return [(v >> 2 * k & 1) + (v >> 2 * k + 1 & 1) for k in range(32)]

    for x, y, r in zip(xs, ys, got, strict=True):
        assert r.d == sum(abs(a - b) for a, b in zip(counts(x), counts(y), strict=True)) <= (x ^ y).bit_count()


def test_subspaces_follow_the_number_of_fingerprints():
    sizes = [10**e for e in range(3, 12)]
    chosen = [simhash.subspaces(n) for n in sizes]
    assert chosen == sorted(chosen) and chosen[0] == 6 and chosen[-1] > 9
    for n, k in zip(sizes, chosen, strict=True):
        assert sorted(a for axes in simhash._axes(k) for a in axes) == list(range(32))
        assert k == 12 or simhash.candidates(n, k) <= n * comb(k, 3)


def test_candidates_are_as_many_as_expected():
    """Pairs of random fingerprints that share a cell, counted one by one."""
    rng, n, k = np.random.default_rng(4), 100_000, 6
    low = np.uint64(simhash.LOW)
    fps = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    one = np.uint64(1)
    points = ((fps | fps >> one) & low) | ((fps & fps >> one & low) << one)
    pairs_ = 0
    for cell in combinations(simhash._masks(k), k - 3):
        _, c = np.unique(points & np.uint64(sum(cell)), return_counts=True)
        pairs_ += int((c * (c - 1) // 2).sum())
    assert 0.8 < pairs_ / simhash.candidates(n, k) < 1.25


@pytest.mark.parametrize("most, k", [(1000, None), (4, None), (1000, 7), (4, 9), (1000, 12)])
def test_links_connect_what_distances_connect(spark, most, k):
    """Random fingerprints and dense balls around some; small cells give the links themselves."""
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(200)} | {0, 1, (1 << 64) - 1}
    for c in list(fps)[:12]:
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(25)}
    near = {tuple(sorted((simhash._signed(a), simhash._signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = [tuple(r) for r in links(df, most, k).collect()]
    assert brute_components(found) == brute_components(near)
    if most == 1000:
        assert len(found) == len(near) and {tuple(sorted(p)) for p in found} == near


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1400)] + [(2000, k) for k in range(2001, 2600)]
    df = spark.createDataFrame([*edges, (None, 1), (5000, None), (6000, 6000)], "a long, b long").repartition(9)
    assert {r.node: r.root for r in components(df).collect()} == brute_components(edges)
    assert components(df.limit(0)).count() == 0


def test_busy_node_is_split(spark):
    """The join with the minima of a star of one node has a skewed side that adaptive execution splits."""
    held = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        star = stored(spark.range(1, 200_000).selectExpr("if(id % 50 = 0, id, 0) u", "id v"), "star")
        least = stored(star.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = with_least(star, least)
        assert joined.where("v = m or u = 0").count() > 100_000
        joined.write.format("noop").mode("overwrite").save()
        again = with_least(star, least)
        again.collect()
        assert "skew=true" in again._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def near_copies():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = [None, "", "x", "X", "one two three"] * 2
    for _ in range(12):
        base = [word() for _ in range(150)]
        for k in range(5):
            w = list(base)
            w[k * 20] = word() if k else w[0]
            texts.append(" ".join(w))
    return list(enumerate(texts))


def test_query_against_brute_force(spark, tmp_path):
    rows = [*near_copies(), (None, "one two three"), (3, "x"), (None, "alone here now")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "root": F.lit(1), "cell": F.lit(2)}).write.parquet(path)
    fps = [brute_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root, ids = brute_components(edges), defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root.get(i, i)].append(d)
    want = sorted((str(d), f"{fps[i]:016x}", str(min((x for x in ids[root.get(i, i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in op3_simhash_dedup(spark, str(tmp_path)).collect()) == want
    docs = spark.read.parquet(path)
    stay = representatives(docs)
    assert stay.columns == docs.columns and stay.count() == len({root.get(i, i) for i in range(len(rows))})
    assert op3_simhash_dedup(spark, str(tmp_path)).count() == len(rows) and representatives(docs.limit(0)).count() == 0


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.grouped(none).count() == 0


# Cover trees


def clustered(rng, n, d=16):
    centres = rng.normal(size=(12, d))
    return np.vstack([centres[k % 12] + rng.normal(size=d) * (0.03 if k % 3 else 1.0) for k in range(n)])


def test_tree_is_nested_and_traversal_loses_nothing():
    rng = np.random.default_rng(9)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (clustered(rng, 300), clustered(rng, 200)))
    reach = 0.2
    a, b = CoverTree(x, reach / 4), CoverTree(y, reach / 4)
    for k, kids in enumerate(a.children):
        assert np.linalg.norm(x[a.rows[k]] - x[a.centre[k]], axis=1).max() <= a.radius[k] + 1e-12
        if kids is not None:
            assert a.centre[kids[0]] == a.centre[k] and sorted(np.concatenate([a.rows[c] for c in kids])) == sorted(a.rows[k])
    for t, u, same in ((a, b, False), (a, a, True)):
        found = [(p, q) for ps, qs in pairs(t, u, reach) for p, q in zip(ps.tolist(), qs.tolist(), strict=True)]
        d = np.linalg.norm(t.x[:, None] - u.x[None], axis=2)
        want = {(i, j) for i, j in zip(*np.nonzero(d <= reach), strict=True) if not same or i < j}
        found = {tuple(sorted(p)) for p in found} if same else set(found)
        assert want <= found and len(found) < d.size / 2


def brute_vectors(rows, threshold=0.98):
    def ok(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(p, q):
        (i, v, label), (j, w, other) = p, q
        if None in (label, other) or label != other or not ok(v) or not ok(w) or len(v) != len(w):
            return False
        v, w = np.array(v), np.array(w)
        return v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold

    n = [0] * len(rows)
    edges = []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if linked(rows[a], rows[b]):
                n[a] += 1
                n[b] += 1
                edges.append((a, b))
    root, least = brute_components(edges), {}
    for a, r in enumerate(rows):
        k = root.get(a, a)
        least[k] = min((x for x in (least.get(k), r[0]) if x is not None), default=None)
    return sorted((repr(r[0]), n[a], repr(least[root.get(a, a)])) for a, r in enumerate(rows))


@pytest.mark.parametrize("block_rows, most_centres", [(2000, 2000), (20, 2000), (20, 2), (7, 40)])
def test_groups_against_brute_force(spark, block_rows, most_centres):
    rng = np.random.default_rng(10)
    rows = [(k, [float(np.float32(x)) for x in v], int(k % 3 == 0)) for k, v in enumerate(clustered(rng, 150, 8))]
    rows += [(200 + k, [1.0] * 8, 0) for k in range(9)] + [(300, [2.0] * 8, 0), (301, [1.0] * 8, None), (302, [1.0] * 4, 0), (303, [1.0] * 4, 0)]
    rows += [(310, None, 0), (311, [], 0), (312, [0.0] * 8, 0), (313, [None] + [1.0] * 7, 0), (314, [float("nan")] + [1.0] * 7, 0), (315, [float("inf")] + [1.0] * 7, 0)]
    rows += [(None, [1.0] * 8, 0), (5, rows[5][1], rows[5][2]), (None, rows[7][1], rows[7][2]), (None, [9.0] + [-1.0] * 7, 0), (None, [9.0] + [-1.0] * 7, 0)]
    rows += [(1, rows[40][1], rows[40][2]), (1, rows[41][1], rows[41][2]), (0, [1.0] * 8, 1), (300, [1.0, -1.0] * 4, 0), (302, [3.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit("x"), "group": F.lit(1), "n_links": F.lit(2), "v": F.lit(3)})
    out = grouped(df, block_rows=block_rows, most_centres=most_centres).collect()
    assert sorted((repr(r.vec_id), r.n_links, repr(r.component_id)) for r in out) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_one_id_with_two_vectors(spark):
    """Within a label and across labels: an id joins nothing, only vectors do."""
    rows = [(5, [1.0, 0.0], 0), (6, [1.0, 0.001], 0), (5, [0.0, 1.0], 1), (3, [0.001, 1.0], 1), (6, [0.0, -1.0], 0), (8, [0.001, -1.0], 0)]
    out = grouped(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out)
    assert got == sorted([(5, 1, 5, True), (6, 1, 5, False), (5, 1, 3, False), (3, 1, 3, True), (6, 1, 6, True), (8, 1, 6, False)])
    assert sorted((repr(r.vec_id), r.n_links, repr(r.component_id)) for r in out) == brute_vectors(rows)


def test_forest_of_many_links_joins_what_they_join():
    rng = np.random.default_rng(12)
    s, t = rng.integers(0, 300, 500), rng.integers(0, 300, 500)
    s, t = np.concatenate([s, np.repeat(np.arange(40), 40)]), np.concatenate([t, np.tile(np.arange(40), 40)])
    groups = Groups(300)
    groups.join(s, t)
    want = brute_components(zip(s.tolist(), t.tolist(), strict=True))
    assert {a: groups.top[a] for a in want} == want and all(groups.top[a] == a for a in range(300) if a not in want)


def test_no_vectors(spark):
    assert grouped(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vector_query_equals_sql(spark, sf_dir, same):
    same(entry.queries()["op7_cover_tree"](spark, sf_dir), entry.oracle_sql()["op7_cover_tree"])

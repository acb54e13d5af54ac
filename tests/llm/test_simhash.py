import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillstage.llm import simhash
from tests.conftest import SF

UPPER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows):
    """(id, fingerprint) rows to their components by comparing all pairs."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, (_, x)), (j, (_, y)) in itertools.combinations(enumerate(rows), 2):
        if (x ^ y).bit_count() <= 4:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, x, least.get(find(i))) for i, (d, x) in enumerate(rows))


def found(docs):
    return collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs) == classes([(r.doc_id, fingerprint(r.text)) for r in docs.collect()])
    got = simhash.QUERIES["op13_simhash_near_dedup"](spark, SF)
    assert {r.doc_id: r.fingerprint for r in got.collect()} == {r.doc_id: f"{fingerprint(r.text):016x}" for r in docs.collect()}


def test_odd_texts():
    texts = [None, "", " \n", "a", "A b", "a  b\tc", "a b c d", "É b\x0bc d é", "x y z   w v u", "one two three four five " * 40, "", "end"]
    hashes, ends = simhash.shingle_hashes(pa.array(texts))
    assert [int(x) for x in simhash.majority(hashes, ends)] == [fingerprint(t) for t in texts]
    many = ["w1 w2 w3 w4"] + [" ".join(random.Random(i).choices(["a", "b", "c", "d"], k=900)) for i in range(9)]
    hashes, ends = simhash.shingle_hashes(pa.array(many))
    for part in (1, 7, 1000):
        before, simhash.BITS_AT_ONCE = simhash.BITS_AT_ONCE, part
        assert [int(x) for x in simhash.majority(hashes, ends)] == [fingerprint(t) for t in many]
        simhash.BITS_AT_ONCE = before


def test_trees_find_all_within_the_radius():
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    points = list({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for s in seeds for _ in range(25)})
    tree = [rng.randrange(3) for _ in points]
    forest = simhash.Forest(np.array(points, np.uint64).view(np.int64), np.array(tree))
    queries = np.array(points, np.uint64).view(np.int64)
    for radius in (0, 2, 4):
        for t, root in enumerate(forest.roots.tolist()):
            got = {(int(q), int(p)) for a, b in forest.search(queries, np.full(len(queries), root), radius) for q, p in zip(a, b, strict=True)}
            assert got == {(i, j) for i, x in enumerate(points) for j, y in enumerate(points) if tree[j] == t and (x ^ y).bit_count() <= radius}
    # edges are distances to the parent
    assert (simhash.distance(forest.points[forest.children], forest.points[forest.keys // 65]) == forest.keys % 65).all()


def test_a_search_leaves_most_of_a_tree_alone(monkeypatch):
    g = np.random.default_rng(2)
    points = g.integers(0, 1 << 63, 20000).astype(np.int64)
    forest, visits = simhash.Forest(points, np.zeros(20000)), []
    real = simhash.distance
    monkeypatch.setattr(simhash, "distance", lambda a, b: visits.append(len(a)) or real(a, b))
    assert sum(len(a) for a, _ in forest.search(points[:100], np.zeros(100, np.int64))) == 100
    assert sum(visits) < 100 * 20000 / 4


@pytest.mark.parametrize("n", [10, 10**5, 10**7, 10**10])
def test_every_pair_within_the_radius_shares_a_shard(n):
    rng, chosen = random.Random(n), simhash.cuts(n)
    masks = [sum(((1 << bits) - 1) << first for first, bits in c) for c in chosen]
    for _ in range(500):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not x & m for m in masks)


def linked(spark, points, monkeypatch, tree=None, shard=None):
    if tree:
        monkeypatch.setattr(simhash, "TREE", tree)
    if shard:
        monkeypatch.setattr(simhash, "SHARD", shard)
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(nodes).collect()]
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return links, {frozenset(q for q in points if find(q) == find(p)) for p in points}


@pytest.mark.parametrize(("tree", "shard", "most"), [(None, None, None), (16, None, None), (16, 10**6, 0)])
def test_chains_and_large_groups(spark, monkeypatch, tree, shard, most):
    if most is not None:
        monkeypatch.setattr(simhash, "MOST_TREES", most)
    rng, points = random.Random(5), set()
    for _ in range(20):  # chains in steps of 4 and of 5 bits
        x = rng.getrandbits(64)
        for step in (4, 4, 5, 4, 3, 6):
            points.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), step))
    seed = rng.getrandbits(64)
    points = list(points | {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)})
    links, got = linked(spark, points, monkeypatch, tree, shard)
    rows = classes(list(enumerate(points)))
    expected = collections.defaultdict(set)
    for i, p, c in rows:
        expected[c].add(p)
    assert got == {frozenset(x) for x in expected.values()}


def test_links_of_a_group_do_not_grow_with_its_pairs(spark, monkeypatch):
    points = [0b1111 << 60 | 1 << i | 1 << j for i, j in itertools.combinations(range(30), 2)]  # all within 4 bits of each other
    links, got = linked(spark, points, monkeypatch)
    assert got == {frozenset(points)} and len(links) < len(points) * len(simhash.cuts(len(points))) * 2


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, fingerprint(r.text)) for r in odd.select("doc_id", "text").collect()]
    assert found(odd) == classes(rows)
    assert simhash.near_duplicates(nothing).count() == 0


def test_null_and_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(None, base), (None, base), (7, base + " end"), (7, "other words stand here"), (3, None), (None, " "), (2, ""), (9, "other  words stand here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("own")).withColumn("least", F.lit("own"))
    assert found(docs) == classes([(d, fingerprint(t)) for d, t in rows])
    alone = spark.createDataFrame([(None, "a b c"), (None, "x y z")], "doc_id long, text string")
    assert found(alone) == classes([(None, fingerprint("a b c")), (None, fingerprint("x y z"))])

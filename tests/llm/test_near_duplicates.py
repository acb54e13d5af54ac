import collections
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillstage.llm import minhash
from quillstage.llm.components import components
from tests.conftest import SF, same_rows

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_rows(rows):
    """(id, size of the set, component id) of every row, and one row of each component, by comparing all pairs with a common shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = {}
    for i, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(i)
    pairs = {p for ds in owners.values() if len(ds) > 1 for p in itertools.combinations(ds, 2)}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {g: min((rows[i][0] for i in members if rows[i][0] is not None), default=None) for g, members in groups.items()}
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))], [[rows[i] for i in members] for members in groups.values()]


def brute(rows):
    return {d: (n, c) for d, n, c in brute_rows(rows)[0]}


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_chain_of_edits_in_one_large_group(spark):
    rng, base = random.Random(5), [f"w{i}" for i in range(120)]
    rows = []
    for d in range(300):
        words = list(base)
        for _ in range(d % 9):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows)


def same(spark, rows):
    """Asserts that operator and brute force agree, and that one row of each component is kept."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit("own"))
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()), key=key)
    expected, groups = brute_rows(rows)
    assert got == sorted(expected, key=key)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    left = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert sum(left.values()) == len(groups)
    for members in groups:
        ids = [d for d, _ in members if d is not None]
        assert sum(left[m] for m in set(members) if m[0] == min(ids, default=None)) >= 1


def test_null_and_repeated_ids(spark):
    rng, rows = random.Random(8), []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(60)]
        for k in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            rows += [(rng.choice([None, None, g, g % 7, 1000 + len(rows)]), " ".join(words))] * rng.choice((1, 1, 1, 3))
    rows += [(None, None), (None, ""), (3, ""), (3, "one two"), (4, "one two"), (None, "one  two"), (5, "two one")]
    same(spark, rows)


def test_rows_without_any_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    same(spark, [(None, text), (None, text), (None, text + " end"), (None, "else"), (None, "else"), (None, "else")])
    same(spark, [(3, text), (3, text.replace("w", "v")), (1, text.replace("w", "v")), (3, text + " end")])


def test_odd_rows(odd):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(odd).collect()}
    assert got[0, 0] == 0 and got[1, 0] == 1 and got[2, 0] == 2 and got[3, 1] == 3
    assert got[4, len(shingles(odd.filter("doc_id = 5").first().text))] == 4
    # the text without an id has the shingles of those with the ids 4, 5 and 9
    assert {c for (d, _), c in got.items() if d in (None, 5, 9)} == {4}
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_blocks_of_a_bucket_may_be_small(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "TASK_ROWS", 20)
    monkeypatch.setattr(minhash, "PART_BYTES", 2000)
    rng, rows, common = random.Random(6), [], [f"w{i}" for i in range(70)]
    for d in range(120):
        rows.append((d, " ".join([*common, *(f"f{d // 4}_{i}" for i in range(20)), *(f"x{rng.randrange(9**9)}" for _ in range(d % 4))])))
    same(spark, rows)


def test_empty(nothing):
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.keep_one(nothing).count() == 0


def test_sketches_merge_and_estimate():
    g = np.random.default_rng(1)
    a, b = (g.integers(0, 1 << 63, 2000, np.uint64) for _ in range(2))
    assert (np.maximum(minhash.registers(a), minhash.registers(b)) == minhash.registers(np.concatenate([a, b]))).all()
    for common in (1600, 1700, 1800):
        one, two = a, np.concatenate([a[:common], b[: 2000 - common]])
        near = minhash.estimate(minhash.registers(one), minhash.registers(two)[None], 2000, np.array([2000]))[0]
        assert abs(near - common / (4000 - common)) < 0.12


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, 7), (7, 100), (5, 5), (200, 300), (300, 250)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 10 for i in range(11, 61)) and got[100] == 7 and got[300] == 200 and got[250] == 200 and 5 not in got


def test_query_equals_oracle(spark, duck):
    same_rows(minhash.QUERIES["op1_minhash_near_dedup"](spark, SF), duck, minhash.SQL["op1_minhash_near_dedup"])


def test_kept_is_smallest(spark):
    rows = minhash.QUERIES["op1_minhash_near_dedup"](spark, SF)
    assert rows.filter(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0

import collections
import hashlib
import math

import pytest

from pyspark.sql import functions as F

from quillstage.llm import mixing
from tests.conftest import SF, same_rows


def test_query_equals_oracle(spark, duck):
    same_rows(mixing.QUERIES["op7_mixing"](spark, SF), duck, mixing.SQL["op7_mixing"])


def test_rates_meet_targets(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    out = {r.source: r.n for r in mixing.mix(docs, weights={"a": 3.0, "b": 1.0}, total=10000).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(out["a"] - 7500) < 4 * math.sqrt(7500) and abs(out["b"] - 2500) < 4 * math.sqrt(2500)


def test_counts_are_poisson(spark):
    docs = spark.range(40000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    n = {r.c: r.n for r in mixing.mix(docs, total=60000).groupBy("doc_id").agg(F.count("*").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
    for k in (1, 2, 3, 4):
        expected = 40000 * math.exp(-1.5) * 1.5**k / math.factorial(k)
        assert abs(n[k] - expected) < 5 * math.sqrt(expected)


def test_large_and_zero_rates(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, source string")
    out = mixing.mix(docs, weights={"a": 1.0, "b": 0.0}, total=2000.0).groupBy("source").count().collect()
    assert [r.source for r in out] == ["a"] and abs(out[0]["count"] - 2000) < 5 * math.sqrt(2000)


def test_odd_rows(odd, nothing):
    out = mixing.mix(odd)
    assert set(odd.columns) <= set(out.columns)
    copies = {}
    for r in out.collect():
        copies.setdefault((r.doc_id, r.text), []).append(r.mix_copy)
    assert all(sorted(v) == sorted(list(range(1, max(v) + 1)) * (len(v) // max(v))) for v in copies.values())
    assert mixing.mix(nothing).count() == 0


def test_rows_without_id_are_spread(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "a", {"k": i}) for i in range(500)], "doc_id long, text string, source string, notes map<string,int>")
    out = mixing.mix(docs).collect()
    assert len({r.mix_key for r in out}) == len(out) and abs(len(out) - 500) < 5 * math.sqrt(500)
    assert 100 < len({r.text for r in out}) < 450


def brute(rows, total=None):
    """Copies of every document by inverting Poisson distributions at the hash of its id."""
    n = collections.Counter(r.source for r in rows)
    weights = {k: math.sqrt(v) for k, v in n.items()}
    out = collections.Counter()
    for r in rows:
        rate = weights[r.source] / sum(weights.values()) * len(rows) / n[r.source]
        u = (int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, term = 0, math.exp(-rate)
        below = term
        while below <= u:
            k += 1
            term *= rate / k
            below += term
        if k:
            out[r.doc_id] = k
    return out


def test_copies_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert collections.Counter(r.doc_id for r in mixing.mix(docs).collect()) == brute(docs.select("doc_id", "source").collect())


def test_clashing_names(clashing):
    out = mixing.mix(clashing)
    assert out.columns == clashing.columns and out.count() > 0
    assert out.filter("mix_rate <> 'own mix_rate' or mix_copies <> 'own mix_copies' or mix_key <> 'own mix_key' or row <> 'own row'").count() == 0


def test_a_rare_source_beside_a_large_one(spark):
    rated = spark.createDataFrame([("rare", 31_622.8), ("one", 1.0), ("none", 0.0), ("huge", 4e6), (None, 0.25)], "mix_source string, mix_rate double")
    rows = {r.mix_source: r for r in mixing.distributions(rated).collect()}
    # as long as eighteen standard deviations, not as the mean
    assert len(rows["rare"].mix_cdf) < 18 * math.sqrt(31_622.8) + 70 and len(rows["huge"].mix_cdf) < 18 * 2000 + 70 and rows["none"].mix_cdf == [1.0]
    for source, rate in (("rare", 31_622.8), ("one", 1.0), ("huge", 4e6), (None, 0.25)):
        r = rows[source]
        low, cdf = r.mix_low, r.mix_cdf
        assert abs(cdf[-1] - 1) < 1e-12 and cdf[0] < 1e-15 + math.exp(-rate) * (low == 0)
        near = round(rate)
        exact = sum(math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(low, near + 1))
        assert abs(cdf[near - low] - exact) < 1e-9 + 1e-15 * rate  # as far as lgamma of so large numbers is exact


@pytest.mark.parametrize("most", [16_000_000, 0])
def test_one_document_repeated_very_often(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", most)
    docs = spark.range(4001).selectExpr("id AS doc_id", "if(id = 0, 'rare', 'common') AS source")
    n = {r.doc_id: r["count"] for r in mixing.mix(docs, total=3e5).groupBy("doc_id").count().collect()}
    share = 3e5 / (1 + math.sqrt(4000))
    assert abs(n[0] - share) < 6 * math.sqrt(share) and abs(sum(n.values()) - 3e5) < 6 * math.sqrt(3e5)


def test_halving_finds_the_place(spark):
    numbers = [0.1, 0.2, 0.2, 0.5, 0.9, 1.0, 1.0]
    rows = spark.createDataFrame([(numbers[:k], p / 20) for k in range(1, 8) for p in range(22)], "c array<double>, p double")
    for r in rows.select("c", "p", mixing._upto("c", F.col("p")).alias("n")).collect():
        assert r.n == sum(x <= r.p for x in r.c)

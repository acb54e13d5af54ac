import collections
import re
import unicodedata

import numpy as np

from quillstage.llm import quality
from tests.conftest import SF


def figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def row(r):
    return r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words


def test_figures_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for r in quality.with_features(docs).collect():
        assert row(r) == figures(r.text)


def test_clashing_names(clashing, odd):
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns and kept.filter("q_n_words <> 'own q_n_words' or q_kept <> 'own q_kept' or row <> 'own row'").count() == 0
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in quality.keep_good(odd).collect())


def test_odd_rows(odd):
    out = quality.judged(quality.with_features(odd)).collect()
    assert len(out) == odd.count()
    for r in out:
        assert row(r) == figures(r.text)
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {None, 4, 5, 6, 9}


def test_empty(nothing):
    assert quality.keep_good(nothing).count() == 0


def test_estimate_finds_planted_accuracies():
    import random

    rng, n = random.Random(3), collections.Counter()
    for _ in range(20000):
        good = rng.random() < 0.7
        n[tuple(None if rng.random() < 0.4 else int((rng.random() < a) == good) for a in (0.95, 0.8, 0.9, 0.7))] += 1
    model = quality.estimate(list(n.items()), 4)
    assert abs(model[0] - 0.7) < 0.05
    assert all(abs(x - a) < 0.05 for x, a in zip(quality.accuracies(model), (0.95, 0.8, 0.9, 0.7), strict=True))


def test_agrees_with_labels(spark):
    got = quality.QUERIES["op2_quality_rules"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = got.withColumnRenamed("quality", "q").join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.97 * sum(r.quality == 0 for r in rows)


def brute_votes(text):
    n, chars, symbols, dup, again = figures(text)
    t = text or ""
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    distinct = len(set(re.findall(r"[^\x20\x09-\x0D]+", t)))
    upper, stops = sum(unicodedata.category(c) == "Lu" for c in t), len(re.findall("[.!?。！？]", t))
    bad = [
        n < 5, 5 * symbols > n, 5 * again > n, 10 * dup > 3 * len(lines), 10 * upper > 3 * chars, chars < 2 * n or chars > 14 * n,
        n < 5000 and 5 * distinct < n, n >= 40 and 200 * stops < n
    ]
    plain = 50 * symbols <= n
    good = [False] * 6 + [plain and 5 * distinct >= 2 * n, plain and stops >= 1 and 60 * stops >= n]
    return [0 if b else 1 if g else None for b, g in zip(bad, good, strict=True)], n < 10 or 100 * again > 20 * n


def brute_quality(votes, rounds=200):
    """Posteriors by expectation-maximisation over all rows, with numpy."""
    place = np.array([[{1: 0, 0: 1, None: 2}[v] for v in row] for row in votes])
    seen = np.eye(3)[place]  # row, rule, outcome
    silent = (place == 2).all(axis=1)
    start = np.array([[0.45, 0.05, 0.5], [0.05, 0.45, 0.5]])
    chances, share = np.repeat(start[:, None], place.shape[1], axis=1), 0.8

    def posterior():
        odds = np.log(share / (1 - share)) + np.where(silent, 0, (seen * np.log(chances[0] / chances[1])).sum(axis=(1, 2)))
        return 1 / (1 + np.exp(-odds))

    for _ in range(rounds):
        p, before = posterior(), share
        sums = np.stack([(seen * w[:, None, None]).sum(axis=0) + 2 * s for w, s in ((p, start[0]), (1 - p, start[1]))])
        share = min(0.999, max(0.5, p.mean()))
        chances = sums / sums.sum(axis=2, keepdims=True)
        if abs(before - share) < 1e-10:
            break
    return posterior()


def test_verdicts_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [
        (10**6 + i, t) for i,
        t in enumerate([None, "", "a b", "ÉTÉ ÉTÉ " * 9, "# $ % " * 30, "one two three four five six seven eight nine ten eleven", "x. " * 60, "l\n" * 40])
    ]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    voted = [brute_votes(r.text) for r in rows]
    posterior = brute_quality([v for v, _ in voted])
    expected = {r.doc_id: (failed, round(float(p), 5), not failed and p >= 0.5) for r, (_, failed), p in zip(rows, voted, posterior, strict=True)}
    got = {r.doc_id: (r.base_failed, round(r.quality, 5), r.kept) for r in quality.QUERIES["op2_quality_rules"](spark, str(tmp_path)).collect()}
    assert got == expected

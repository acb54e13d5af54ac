import collections
import glob
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstage.llm import collocations
from tests.conftest import SF, same_rows

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, longest=5, top=2000, cover=100):
    """The contract word by word: (lang, rank, phrase, a, l, r, n, score)."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = {q[i : i + k] for q, b in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= cover * candidates[q[i : i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in covered:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((" ".join(p), a, left, right, n[lang], score))
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(found[:top])]
    return sorted(out)


def got(docs, **parameters):
    rows = collocations.collocations(docs, **parameters).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    return sorted(tuple(r) for r in rows)


def texts(seed=3, n=200):
    rng, vocabulary = random.Random(seed), ["a", "b", "New", "york", "é", "ß", "x y", "it's", "-"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "!"]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 60)):
            out += ["new York city hall" if rng.random() < 0.1 else rng.choice(vocabulary), rng.choice(marks)]
        rows.append(("".join(out), rng.choice(["en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \t", "fr"), (".,;", "de")]


@pytest.mark.parametrize("most", [10**6, 0])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(collocations, "MOST_BROADCAST", most)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 2000)
    rows = texts()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert got(docs, least=5) == brute(rows, 5)
    assert got(docs, least=8, longest=3, cover=60, top=7) == brute(rows, 8, 3, 7, 60)


def test_broadcast_and_join_agree_on_the_tables(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    few = got(docs, least=30)
    monkeypatch.setattr(collocations, "MOST_BROADCAST", 0)
    assert few == got(docs, least=30) == brute(rows, 30)


def test_ties_repeats_and_covered_phrases(spark):
    rows = [("one two three. one two three", "en")] * 4 + [("one two", "en"), ("two four! four two", "xx")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert got(docs, least=3) == brute(rows, 3)
    # of a run of one word every phrase is inside the longer ones, less one place for each row
    same = [("z " * 50, "en")] * 3
    assert got(spark.createDataFrame(same, "text string, lang string"), least=100) == brute(same, 100)


def test_products_beyond_64_bits(spark):
    names = spark.createDataFrame([(10**13, [10**14, 10**13], [3 * 10**12, 10**13], "en", "a b")], "f long, heads array<long>, tails array<long>, lang string, phrase string")
    totals = spark.createDataFrame([("en", 10**15 + 7)], "lang string, total long")
    row = collocations.scored(names, 2, totals).first()
    assert row.score == 1000 * 10**13 * (10**15 + 7) // (10**14 * 3 * 10**12)


def test_odd_rows(odd, nothing):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert got(odd, least=6) == brute(rows, 6)
    assert got(odd, least=10**6) == [] and got(nothing) == []


def test_rewriting_of_a_sequence():
    seq = np.array([1, 2, 3, 0, 2, 3, 2, 1, 2], np.int32)
    out, first, last, n = collocations.rewritten(seq, np.array([11, 0, 13]))
    assert len(first) == 0 and not out.any()
    out, first, last, n = collocations.rewritten(seq, np.array([0, 12, 13]))
    assert list(zip(first.tolist(), last.tolist(), n.tolist(), strict=True)) == [(12, 13, 2), (13, 12, 1)]
    assert [x for x in out.tolist() if x] == [1, 1, 2]


def test_names_point_to_their_parts(spark):
    docs = spark.createDataFrame([("a b c d", "en")] * 4, "text string, lang string")
    names, totals = collocations.phrases(docs, least=4, longest=3)
    words = {r.id: r.phrase for r in names[0].collect()}
    pairs = {r.id: (words[r["first"]], words[r["last"]]) for r in names[1].collect()}
    assert sorted(pairs.values()) == [("a", "b"), ("b", "c"), ("c", "d")]
    assert sorted((pairs[r["first"]], pairs[r["last"]], r.phrase, r.heads, r.tails) for r in names[2].collect())[0] == (("a", "b"), ("b", "c"), "a b c", [4, 4, 4], [4, 4, 4])
    assert totals.first().total == 16 and names[0].agg(F.min("id"), F.max("id")).first() == (1, 4)


def test_query_equals_oracle(spark, duck):
    same_rows(collocations.QUERIES["op11_phrase_collocation_mining"](spark, SF), duck, collocations.SQL["op11_phrase_collocation_mining"])


def test_few_blocks_are_held_at_once(spark, monkeypatch):
    seen = []

    def watched(df, name, **options):
        out = written(df, name, **options)
        if name.endswith("blocks"):
            files = glob.glob(f"{out.written_to.removeprefix('file:')}/*.parquet")
            seen.extend(m.row_group(k).num_rows for f in files for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups))
        return out

    written = collocations.written
    monkeypatch.setattr(collocations, "written", watched)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 500)
    docs = spark.createDataFrame(texts(), "text string, lang string").coalesce(1)
    collocations.phrases(docs, least=5, longest=3)
    assert len(seen) > 9 and sum(seen) > 30 and max(seen) <= collocations.GROUP

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstage.llm import packing, tokens
from tests.conftest import SF


def lower_bound(counts):
    return -(-sum(k * n for k, n in counts.items()) // packing.CAPACITY)


def placed(counts):
    plan = packing.Plan.best(counts)
    length = np.concatenate([np.full(n, k) for k, n in counts.items()])
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = plan.find(length, rank)
    order = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[order], offset[order], length[order]
    starts = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
    assert (offset[starts] == 0).all()
    inner = np.setdiff1d(np.arange(len(order)), starts)
    assert (offset[inner] == offset[inner - 1] + length[inner - 1]).all()
    assert (np.add.reduceat(length, starts) <= packing.CAPACITY).all()
    assert len(starts) == plan.sequences == len(set(sequence.tolist()))
    return plan.sequences


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_packings(seed):
    rng = random.Random(seed)
    high = rng.choice((300, 1500, 4096))
    counts = {k: rng.randint(1, 40) for k in rng.sample(range(1, high + 1), min(high, rng.randint(1, 400)))}
    assert placed(counts) <= 1.25 * lower_bound(counts) + 1


def test_grouping_beats_first_fit():
    rng = random.Random(2)
    counts = {k: rng.randint(0, 30) or 1 for k in range(900, 1700)}
    bins = []
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            for i, room in enumerate(bins):
                if room >= k:
                    bins[i] -= k
                    break
            else:
                bins.append(packing.CAPACITY - k)
    assert placed(counts) < len(bins)


def test_small_pieces_fill():
    assert placed({4096: 3, 1: 5000}) == 3 + 2
    assert placed({2048: 4}) == 2
    assert placed({1: 1}) == 1


def test_pieces_equal_the_tokenizer(spark, odd):
    t = Tokenizer.from_file(tokens.vocabulary_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.filter("doc_id <> 4").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.cut(docs).collect()}
    expected = {}
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        expected |= {(r.doc_id, k): (s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))}
    assert got == expected


def test_any_text_encodes_alike():
    e, rng = tokens.encoder(tokens.vocabulary_path()), random.Random(3)
    parts = [
        "a", "é", "É", "é", "It's", "don't.", "'s", "3.14", "İ.", "ΑΣ.", "ß", "...", "a...b", ".,'s", "<|endoftext|>", "~", " ", "\n", " ",
        " ", "\x1c", "²", "½.", "日本語。", "ﬁ.", "K", "’s", "​", "ª.", "×", "😀.", "\x00", "क़."
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    for first, ids, begins in e.batches(texts):
        for i in range(len(begins) - 1):
            assert e.tokenizer.encode(texts[first + i], add_special_tokens=False).ids == ids[begins[i] : begins[i + 1]].tolist()


def test_query(spark):
    rows = packing.QUERIES["op10_best_fit_packing"](spark, SF).orderBy("sequence_id", "offset").collect()
    at, room = None, 0
    for r in rows:
        if r.sequence_id != at:
            at, room = r.sequence_id, 0
        assert r.offset == room and (room := room + r.length) <= packing.CAPACITY
    n, total = len({r.sequence_id for r in rows}), sum(r.length for r in rows)
    assert n <= 1.01 * -(-total // packing.CAPACITY) + 1


def test_odd_rows(odd, nothing):
    out = packing.pack_documents(odd).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert {r.length for r in out if r.doc_id in (0, 1, 2)} == {1}
    assert packing.pack_documents(nothing).count() == 0
